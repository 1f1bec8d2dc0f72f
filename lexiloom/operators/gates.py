"""Gates: coverage, completeness, uniqueness and quantity of a review, and the sheet of verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import verdict_id

# --- fixed values: prefixes of verdict ids ---------------------------------------------------------------------------
PREFIXES = {
    "glossary_violation": "term", "glossary_violations": "term", "number_missing": "num", "number_mismatches": "num", "decimal_mismatch": "num",
    "symbol_missing": "sym", "symbol_issues": "sym", "cas_missing": "sym", "regulation_missing": "sym", "punctuation_mixed": "sym",
    "temperature_mismatch": "num", "full_unit_untranslated": "unit", "unit_issues": "unit", "format_issue": "fmt", "format_issues": "fmt",
    "client_glossary_violation": "cterm", "client_glossary_violations": "cterm",
}


def type_prefix(kind):  # noqa: ANN001, ANN201
    table = F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, kind), F.lit("unk"))


def verdict_sheet(issues: DataFrame, key: str = "doc_id") -> DataFrame:
    """Issues numbered per type of a document, in order of issue_pos, with their verdict ids."""
    i = F.row_number().over(Window.partitionBy(key, "type").orderBy("issue_pos"))
    return issues.withColumn("verdict_id", verdict_id(type_prefix(F.col("type")), i))


def verdicts_by_paragraph(sheet: DataFrame, key: str = "doc_id") -> DataFrame:
    return sheet.groupBy(key, "paragraph_index").agg(F.sort_array(F.collect_list("verdict_id")).alias("verdict_ids"))


def verdicts_by_type(sheet: DataFrame, key: str = "doc_id") -> DataFrame:
    """How many verdicts of each type a document asks for."""
    return sheet.groupBy(key, "type").agg(F.count("*").alias("n"))


def verdicts_for_batches(sheet: DataFrame, batches: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, batch_id, verdict_id)``: verdicts of a batch's paragraphs, and in every batch those of paragraph 0, whose place is unknown.

    ``batches`` has key, batch_id, paragraph_index.
    """
    rows = sheet.select(key, "paragraph_index", "verdict_id")
    own = batches.select(key, "batch_id", "paragraph_index").distinct().join(rows, [key, "paragraph_index"]).select(key, "batch_id", "verdict_id")
    loose = batches.select(key, "batch_id").distinct().join(rows.filter("paragraph_index = 0"), key).select(key, "batch_id", "verdict_id")
    return own.unionByName(loose).distinct()


def completeness(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of either side that the other lacks: status missing or extra."""
    lost = expected.select(*keys).distinct().join(actual, keys, "left_anti").withColumn("status", F.lit("missing"))
    more = actual.select(*keys).distinct().join(expected, keys, "left_anti").withColumn("status", F.lit("extra"))
    return lost.unionByName(more)


def coverage(paragraphs: DataFrame, covered: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: paragraphs, how many are covered, missing or extra, and the covered share in percent."""
    a = paragraphs.select(key, "paragraph_index").distinct().withColumn("want", F.lit(1))
    b = covered.select(key, "paragraph_index").distinct().withColumn("have", F.lit(1))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    n = a.join(b, [key, "paragraph_index"], "full_outer").groupBy(key).agg(F.count("want").alias("total"), one(F.col("want").isNotNull() & F.col("have").isNotNull()).alias("covered"), one(F.col("have").isNull()).alias("missing"), one(F.col("want").isNull()).alias("extra"))
    return n.withColumn("pct", F.round(F.col("covered") * 100.0 / F.greatest("total", F.lit(1)), 1))


def density(paragraphs: DataFrame, issues: DataFrame, key: str = "doc_id") -> DataFrame:
    """Issues per hundred paragraphs, and whether that is none, abnormally low (under 2) or fine."""
    n = paragraphs.groupBy(key).agg(F.count("*").alias("paras"))
    m = issues.groupBy(key).agg(F.count("*").alias("issues"))
    d = n.join(m, key, "left").withColumn("issues", F.coalesce("issues", F.lit(0)).cast("long")).withColumn("density", F.round(F.col("issues") * 100.0 / F.col("paras"), 1))
    status = F.when(F.col("issues") == 0, "zero").when(F.col("issues") * 100.0 / F.col("paras") < 2, "abnormally_low").otherwise("ok")
    return d.withColumn("status", status)


def quantity(paragraphs: DataFrame, issues: DataFrame, key: str = "doc_id") -> DataFrame:
    """error: no issue at all; warning: one in over 30 paragraphs, under three in over 50, or under 2 per cent."""
    d = density(paragraphs, issues, key)
    n, p = F.col("issues"), F.col("paras")
    level = F.when(n == 0, "error").when((n == 1) & (p > 30), "warning").when((n < 3) & (p > 50), "warning").when(n / p < 0.02, "warning").otherwise("ok")
    return d.select(key, "paras", "issues", level.alias("level"))


def uniqueness(verdicts: DataFrame, key: str = "doc_id", least: int = 3) -> DataFrame:
    """Share of distinct explanations: under 0.3 an error, under 0.5 a warning, for ``least`` verdicts or more."""
    n = verdicts.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("explanation").alias("n_distinct"))
    share = F.col("n_distinct") / F.col("n")
    level = F.when(F.col("n") < least, "ok").when(share < 0.3, "error").when(share < 0.5, "warning").otherwise("ok")
    return n.withColumn("level", level)


def verdict_quality(verdicts: DataFrame, key: str = "doc_id", short: int = 20) -> DataFrame:
    """Per document: verdicts, confirmed ones, and explanations with under ``short`` Chinese characters."""
    cjk = F.regexp_count(F.coalesce("explanation", F.lit("")), F.lit("[一-鿿]"))
    d = verdicts.groupBy(key).agg(F.count("*").alias("n"), F.sum((F.col("verdict") == "confirmed").cast("int")).alias("confirmed"), F.sum((cjk < short).cast("int")).alias("short"))
    return d.withColumn("none_confirmed", F.col("confirmed") == 0)


def field_errors(issues: DataFrame, required: list[str], allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row per issue and field that is absent, empty or outside its allowed values."""
    bad = [F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", F.struct(F.lit(f).alias("field"), F.lit("missing").alias("problem"))) for f in required]
    bad += [F.when(F.col(f).isNotNull() & (F.col(f) != "") & ~F.col(f).isin(*values), F.struct(F.lit(f).alias("field"), F.lit("not allowed").alias("problem"))) for f, values in allowed.items()]
    return issues.select("issue_pos", F.explode(F.array_compact(F.array(*bad))).alias("e")).select("issue_pos", "e.*")


def passed(checks: DataFrame, key: str = "doc_id") -> DataFrame:
    """A document passes if no check of it is an error."""
    n = checks.groupBy(key).agg(F.sum((F.col("level") == "error").cast("int")).alias("errors"), F.sum((F.col("level") == "warning").cast("int")).alias("warnings"))
    return n.withColumn("passed", F.col("errors") == 0)
