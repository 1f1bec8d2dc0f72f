"""Review plans: unknown terms, items by category, risk marks of batches, suspicious tables, empty dimensions, the whole gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import bound
from lexiloom.operators.glossary import substring_matches

# --- fixed values: words that begin with a capital and are no terms -----------------------------------------------------
COMMON_WORDS = (
    "The", "This", "These", "Those", "Each", "All", "Some", "Any", "No", "Not", "When", "Where", "Which", "What", "After", "Before", "During", "Section",
    "Product", "Information", "Identification", "Description", "General", "Special", "Safety", "Health", "Fire", "Handling", "Storage", "Transport", "Disposal",
)
MARKED, CAPITALISED = r"\{\?(.*?)\?\}", r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
# --- fixed values: what a message holds, and how it is shown --------------------------------------------------------------
ERRORS = (
    (("429", "rate limit"), "API 请求太频繁，请稍后重试（限流）"),
    (("401", "unauthorized"), "API 密钥无效，请在 API 设置中检查"),
    (("402", "insufficient"), "API 余额不足，请充值"),
    (("403", "forbidden"), "API 访问被拒绝，请检查密钥权限"),
    (("400", "content", "safety"), "文档内容触发安全审核，请联系管理员"),
    (("timeout", "timed out"), "网络连接超时，请检查网络后重试"),
    (("connection", "refused"), "无法连接到 API 服务器，请检查网络和 Base URL"),
)
OTHER_ERROR = "翻译过程出错: "


def unknown_terms(texts: DataFrame, terms: DataFrame, key: list[str], most: int | None = None) -> DataFrame:
    """``(key, term)``: distinct marked terms {?term?}, and capitalised phrases of over five letters that are neither common
    words nor sources of ``terms``. Null texts have none. ``most`` keeps the first so many of each text, by term."""
    marked = F.transform(F.regexp_extract_all("text", F.lit(MARKED), F.lit(1)), lambda t: F.struct(t.alias("term"), F.lit(True).alias("marked")))
    phrases = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(CAPITALISED), F.lit(0))), lambda t: (F.length(t) > 5) & ~t.isin(*COMMON_WORDS))
    found = texts.select(*key, F.explode(F.concat(marked, F.transform(phrases, lambda t: F.struct(t.alias("term"), F.lit(False).alias("marked"))))).alias("t")).select(*key, "t.*")
    known = terms.select(F.col("source").alias("term")).distinct()
    out = found.filter("marked").select(*key, "term").unionByName(found.filter("not marked").join(known, "term", "left_anti").select(*key, "term")).distinct()
    if most is None:
        return out
    return out.groupBy(*key).agg(F.slice(F.sort_array(F.collect_list("term")), 1, most).alias("t")).select(*key, F.explode("t").alias("term"))


def by_category(items: Column) -> Column:
    """A map from category to its values, in their order, of an array of (category, value, ...).

    Values are sorted by category once and cut where it changes, so an array of many categories is no more work.
    """
    sorted_ = F.array_sort(F.transform(items, lambda i, n: F.struct(i["category"].alias("c"), n.alias("n"), i["value"].alias("v"))))

    def runs(a: Column) -> Column:
        begins = F.filter(F.transform(a, lambda x, n: F.when((n == 0) | (F.get(a, n - 1)["c"] != x["c"]), n)), lambda n: n.isNotNull())
        return bound(begins, lambda at: F.map_from_entries(F.transform(at, lambda n, k: F.struct(F.get(a, n)["c"], F.transform(F.slice(a, n + 1, F.coalesce(F.get(at, k + 1), F.size(a)) - n), lambda x: x["v"])))))

    return bound(sorted_, runs)


def error_message(message: Column) -> Column:
    """What is shown for an error: by the first row of ERRORS of which the message holds a part, in any case."""
    low, out = F.lower(message), None
    for parts, shown in ERRORS:
        hit = reduce(lambda a, b: a | b, [low.contains(p) for p in parts])
        out = F.when(hit, shown) if out is None else out.when(hit, shown)
    return out.otherwise(F.concat(F.lit(OTHER_ERROR), F.substring(message, 1, 200)))


def high_risk_by_batch(paragraphs: DataFrame, high_risk: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, batch_id, high_risk_indices)`` of batches that hold high-risk paragraphs, indices ascending."""
    hit = paragraphs.join(high_risk.select(*keys, "paragraph_index").distinct(), [*keys, "paragraph_index"])
    return hit.groupBy(*keys, "batch_id").agg(F.sort_array(F.collect_set("paragraph_index")).alias("high_risk_indices"))


def split_tables(rows: DataFrame, key: str = "table_id", most: int = 3) -> DataFrame:
    """Tables of two to ``most`` rows whose first row is styled as a header and whose last row has text: ``(key, rows, first_row, last_row)``.

    ``rows`` has key, row, text and header_style; texts are cut to 100 characters.
    """
    n = rows.groupBy(key).agg(F.count("*").alias("rows"), F.min_by(F.struct("text", "header_style"), "row").alias("a"), F.max_by("text", "row").alias("z"))
    n = n.filter(F.col("rows").between(2, most) & F.col("a.header_style") & (F.trim("z") != ""))
    return n.select(key, "rows", F.substring("a.text", 1, 100).alias("first_row"), F.substring("z", 1, 100).alias("last_row"))


def most_severe_first(issues: DataFrame) -> Column:
    """Order of a paragraph's issues: critical, medium, low, others."""
    return F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "medium", 1).when(F.col("severity") == "low", 2).otherwise(3)


def dimension_counts(issues: DataFrame, groups: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, dimension, n)`` for every document and dimension, zero where no issue's check_item holds one of its ids.

    ``groups`` (dimension, check_id) is a fixed list. Distinct check items meet ids, so texts are compared once each.
    """
    items = issues.select("check_item").distinct()
    ids = groups.withColumns({"source": F.col("check_id"), "case_sensitive": F.lit(True)})
    held = substring_matches(items, ids, ["check_item"], "check_item").select("check_item", "dimension").distinct()
    n = issues.select(key, "check_item").join(held, "check_item").groupBy(key, "dimension").agg(F.count("*").alias("n"))
    every = docs.select(key).distinct().join(F.broadcast(groups.select("dimension").distinct()))
    return every.join(n, [key, "dimension"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def dimension_flags(counts: DataFrame, important: list[str], numbers: DataFrame, number_dimension: str, key: str = "doc_id", over: int = 5) -> DataFrame:
    """``(key, flag, dimension, severity)``: dimensions without an issue (high if important), and documents of more than
    ``over`` number issues before (``numbers``: key, n_numbers) whose ``number_dimension`` has none."""
    empty = counts.filter("n = 0").select(key, F.lit("empty_dimension").alias("flag"), "dimension", F.when(F.col("dimension").isin(*important), "high").otherwise("medium").alias("severity"))
    lost = counts.filter((F.col("n") == 0) & (F.col("dimension") == number_dimension)).join(numbers.filter(F.col("n_numbers") > over), key)
    return empty.unionByName(lost.select(key, F.lit("numbers_not_followed").alias("flag"), "dimension", F.lit("high").alias("severity")))


def gate(checks: dict[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """``(key, errors, warnings, failed, passed)`` over all ``checks`` (key, level): failed names those with an error, sorted."""
    rows = reduce(DataFrame.unionByName, [d.select(key, "level", F.lit(name).alias("check")) for name, d in checks.items()])
    one = lambda level: F.sum((F.col("level") == level).cast("int")).cast("long")
    n = rows.groupBy(key).agg(one("error").alias("errors"), one("warning").alias("warnings"), F.sort_array(F.collect_set(F.when(F.col("level") == "error", F.col("check")))).alias("failed"))
    return n.withColumn("passed", F.col("errors") == 0)


def unchecked_level(coverage: DataFrame, key: str = "doc_id", most: int = 2) -> DataFrame:
    """Dimensions left unchecked (``coverage``: key, dimension, checked): more than ``most`` are an error, any a warning."""
    n = coverage.groupBy(key).agg(F.sum((~F.col("checked")).cast("int")).alias("n"))
    return n.select(key, F.when(F.col("n") > most, "error").when(F.col("n") > 0, "warning").otherwise("ok").alias("level"))
