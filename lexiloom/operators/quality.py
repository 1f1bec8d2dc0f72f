"""Quality of translations: terms enforced and verified, and items that a translation must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import procedural
from lexiloom.operators import glossary


def lost_items(items: Column, target: Column) -> Column:
    """Of a source's critical items those that the target lacks; a number with a unit may stand there without it."""
    number = lambda i: F.regexp_extract(i["value"], r"\d+(?:\.\d+)?", 0)
    kept = lambda i: target.contains(i["value"]) | ((i["category"] == "number_with_unit") & target.contains(number(i)))
    return F.filter(items, lambda i: ~kept(i))


def preservation(pairs: DataFrame, key: list[str], source: str = "source_text", target: str = "target_text") -> DataFrame:
    """``(key, total_items, violation_count, high_count, pass_rate)`` of every pair; null sources have no items."""
    d = pairs.select(*key, target, procedural.critical_items(source).alias("items")).withColumn("bad", lost_items(F.col("items"), F.coalesce(target, F.lit(""))))
    high = F.size(F.filter("bad", lambda i: i["category"].isin(*procedural.HIGH)))
    return d.select(*key, F.size("items").alias("total_items"), F.size("bad").alias("violation_count"), high.alias("high_count"), (1 - F.size("bad") / F.greatest(F.size("items"), F.lit(1))).alias("pass_rate"))


def quality_loop(pairs: DataFrame, terms: DataFrame, key: list[str], domain: str | None = None) -> DataFrame:
    """One plan for all pairs: terms of the source are enforced in the target, what is left of them is verified, and
    critical items of the source are sought in the mended target.

    Returns key, final_text, applied (source, target, n), violations, total_items and lost (items). Pairs without a target,
    or whose target is the source itself, are not translated and are left out. Terms have source, target, domain,
    is_regex and case_sensitive, as for ``match_glossary``.
    """
    done = pairs.filter("target_text <> '' and target_text <> source_text")
    hits = glossary.match_glossary(done.select(*key, F.col("source_text").alias("text")), terms, key, domain)
    mine = hits.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "source", "target"))), lambda t: t.dropFields("nth")).alias("_terms"))
    none = F.array().cast("array<struct<source:string,target:string>>")
    d = done.join(mine, key, "left").withColumn("_terms", F.coalesce("_terms", none))
    d = glossary.post_process(d, "target_text", "_terms").withColumn("_items", procedural.critical_items("source_text"))
    return d.select(*key, F.col("fixed_text").alias("final_text"), "applied", "violations", F.size("_items").alias("total_items"), lost_items(F.col("_items"), F.col("fixed_text")).alias("lost"))


def quality_warnings(looped: DataFrame, key: list[str]) -> DataFrame:
    """``(key, type, detail)`` of a quality loop: terms not followed, and lost items of high severity."""
    term = F.transform("violations", lambda v: F.struct(F.lit("术语未遵守").alias("type"), F.concat(F.lit('"'), v["source"], F.lit('" 未翻译为 "'), v["target"], F.lit('"')).alias("detail")))
    high = F.filter("lost", lambda i: i["category"].isin(*procedural.HIGH))
    item = F.transform(high, lambda i: F.struct(F.concat(F.lit("关键项丢失("), i["category"], F.lit(")")).alias("type"), F.concat(F.lit('"'), i["value"], F.lit('" 在译文中未找到')).alias("detail")))
    return looped.select(*key, F.explode(F.concat(term, item)).alias("w")).select(*key, "w.*")


def quality_totals(looped: DataFrame, by: list[str]) -> DataFrame:
    """Sums of a quality loop: terms applied and violated, critical items and those lost."""
    n = lambda c, name: F.sum(F.size(c)).cast("long").alias(name)
    return looped.groupBy(*by).agg(n("applied", "terms_applied"), n("violations", "term_violations"), F.sum("total_items").cast("long").alias("total_items"), n("lost", "lost_items"))
