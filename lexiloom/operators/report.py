"""Reports: summaries, scores and the unified form of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dimension_stats(issues: DataFrame) -> DataFrame:
    """Issues by dimension and severity, with totals of each and of all (null dimension: all)."""
    n = issues.groupBy(F.col("dimension"), F.col("severity")).agg(F.count("*").alias("n"))
    return n.rollup("dimension", "severity").agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))


def examples(issues: DataFrame, label: str = "type", value: str = "source_value", most: int = 3) -> DataFrame:
    """Count per label, and the first ``most`` values in order of issue_pos; ranks are limited before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(label).orderBy("issue_pos"))
    first = issues.withColumn("_n", nth).filter(F.col("_n") <= most).groupBy(label).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", value))), lambda x: x[value]), " | ").alias("examples"))
    return issues.groupBy(label).agg(F.count("*").alias("n")).join(first, label)


def consolidate(issues: DataFrame, key: str = "doc_id") -> DataFrame:
    """Unlocated issues (paragraph_index 0) by type: values in order and the severity of the first."""
    loose = issues.filter("paragraph_index = 0")
    return loose.groupBy(key, "type").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("issue_pos", "source_value"))), lambda x: x["source_value"]), ", ").alias("values"), F.min_by("severity", "issue_pos").alias("severity"), F.count("*").alias("n"))


def quality_scores(d: DataFrame) -> DataFrame:
    """Scores from counts glossary_n, glossary_bad, items_n, items_bad: each one less its share of failures, 4 : 6, with a grade."""
    one = lambda bad, n: F.lit(1.0) - F.col(bad) / F.greatest(F.col(n), F.lit(1))
    overall = 0.4 * F.col("glossary_score") + 0.6 * F.col("critical_score")
    d = d.withColumns({"glossary_score": one("glossary_bad", "glossary_n"), "critical_score": one("items_bad", "items_n")}).withColumn("overall", F.round(overall, 3))
    grade = F.when(F.col("overall") >= 0.95, "excellent").when(F.col("overall") >= 0.85, "good").when(F.col("overall") >= 0.7, "fair").otherwise("poor")
    return d.withColumns({"glossary_score": F.round("glossary_score", 3), "critical_score": F.round("critical_score", 3), "grade": grade})


def drop_status_only(issues: DataFrame, status: tuple[str, ...] = ("paragraph_index", "status")) -> DataFrame:
    """``issues`` less the rows that say nothing but the status of a paragraph: all other columns null."""
    told = F.lit(False)
    for c in issues.columns:
        if c not in status:
            told = told | F.col(f"`{c}`").isNotNull()
    return issues.filter(told)


def glossary_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(source, change, old_target, new_target)``: terms added, removed or translated otherwise, by lower-cased, trimmed source.

    Of rows with one source the last by ``pos`` counts on either side.
    """
    last = lambda d, name: d.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max_by("target", "pos").alias(name))
    both = last(before, "old_target").withColumn("_was", F.lit(True)).join(last(after, "new_target").withColumn("_is", F.lit(True)), "source", "full_outer")
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(~F.col("old_target").eqNullSafe(F.col("new_target")), "changed")
    return both.withColumn("change", change).filter("change is not null").select("source", "change", "old_target", "new_target")


def split_review(issues: DataFrame) -> DataFrame:
    """Part mechanical_reference: typed and unlocated; all others: review."""
    loose = (F.coalesce("type", F.lit("")) != "") & (F.col("paragraph_index") < 1)
    return issues.withColumn("part", F.when(loose, "mechanical_reference").otherwise("review"))


def _first(*names: str) -> Column:
    """The first that is neither null nor ''."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))


def unify_issues(issues: DataFrame) -> DataFrame:
    """Mechanical and semantic issues in one form: what is '' counts as absent."""
    kind = _first("type")
    dim = F.when(kind.contains("glossary"), "术语").when(kind.rlike("number|decimal|percentage|temperature"), "数值").when(kind.rlike("symbol|cas|regulation|punctuation"), "符号").when(kind.rlike("unit"), "单位").when(kind != "", "格式").otherwise("语义")
    return issues.select(
        "issue_pos", "paragraph_index", F.coalesce(F.nullif("dimension", F.lit("")), dim).alias("dimension"), F.coalesce(F.nullif("check_item", F.lit("")), kind).alias("check_item"),
        _first("source_quote", "source_value", "source_term").alias("source_quote"), _first("suggestion", "expected_target").alias("suggestion"),
        F.coalesce(F.nullif("confidence", F.lit("")), F.when(kind != "", "high").otherwise("medium")).alias("confidence"), F.coalesce(F.nullif("severity", F.lit("")), F.lit("medium")).alias("severity"),
    )


def recent(history: DataFrame, most: int = 50) -> DataFrame:
    """The newest records, ids being seconds as text."""
    return history.orderBy(F.desc(F.col("id").cast("long"))).limit(most)


def history(records: DataFrame, there: DataFrame, now: float, days: float | None = None, deleted: DataFrame | None = None, most: int = 50) -> DataFrame:
    """The newest ``most`` records whose file is among ``there`` (path), less those of ``deleted`` ids and older than ``days``.

    ``records`` has id (seconds as text) and path; a record that is added comes first by its id.
    """
    kept = records.join(there.select("path").distinct(), "path", "left_semi")
    if deleted is not None:
        kept = kept.join(deleted.select("id"), "id", "left_anti")
    if days is not None:
        kept = kept.filter(F.col("id").cast("double") >= now - days * 86_400)
    return recent(kept.select(*records.columns), most)


def preview(cells: DataFrame, key: str = "table_index", most: int = 30, cut: int = 100) -> DataFrame:
    """The first cells of each table, cut short."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("row", "col"))
    return cells.withColumn("nth", nth).filter(F.col("nth") <= most).withColumn("text", F.left("text", F.lit(cut)))
