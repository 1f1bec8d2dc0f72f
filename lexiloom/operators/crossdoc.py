"""Across documents and along them: pairing, consistency, propagation, caches, chapters and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import cache_key, file_stem, language_suffix, word_overlap

# --- fixed values: which files are originals, translations or neither ------------------------------------------------
IGNORED = r"^~\$|^\.|\.tmp$|校对稿|校对报告"
ORIGINALS, TRANSLATIONS = (".pdf", ".docx", ".xlsx"), (".docx", ".xlsx")


def scan_files(files: DataFrame, name: str = "filename") -> DataFrame:
    """Files that count, with stem, format, and lang_code and base_name of translations; role original or translation."""
    f = F.col(name)
    kind = F.lower(F.regexp_extract(f, r"\.[^.]*$", 0))
    d = files.filter(~f.rlike(IGNORED)).withColumns({"stem": file_stem(f), "format": kind, "_s": language_suffix(f)})
    d = d.withColumn("role", F.when(F.col("_s").isNotNull() & kind.isin(*TRANSLATIONS), "translation").when(F.col("_s").isNull() & kind.isin(*ORIGINALS), "original"))
    return d.filter("role is not null").withColumns({"lang_code": F.col("_s.lang_code"), "base_name": F.col("_s.base_name")}).drop("_s")


def pair_files(files: DataFrame, name: str = "filename") -> DataFrame:
    """Originals with their translations: status pair, duplicate (several translations), orphan_original or orphan_translation."""
    d = scan_files(files, name)
    o = d.filter("role = 'original'").select(F.col("stem").alias("base"), F.col(name).alias("source_file"))
    t = d.filter("role = 'translation'").select(F.col("base_name").alias("base"), F.col(name).alias("target_file"), "lang_code")
    n = F.count("target_file").over(Window.partitionBy("base", "source_file"))
    status = F.when(F.col("source_file").isNull(), "orphan_translation").when(F.col("target_file").isNull(), "orphan_original").when(n > 1, "duplicate").otherwise("pair")
    return o.join(t, "base", "full_outer").withColumn("status", status)


def term_mismatches(index: DataFrame, multi_ok: DataFrame | None = None) -> DataFrame:
    """Terms that two files or more translate differently, with the translation of most occurrences.

    ``index`` has file, source_term, target, count; a file has a term once. ``multi_ok`` (source_term) may vary.
    """
    d = index.withColumn("key", F.lower(F.trim("source_term")))
    per = d.groupBy("key", "target").agg(F.sum("count").alias("n"), F.sort_array(F.collect_set("file")).alias("files"))
    out = per.groupBy("key").agg(F.count("*").alias("n_targets"), F.max_by("target", F.struct("n", "target")).alias("recommended"), F.max("n").alias("recommended_count"), F.sum("n").alias("total"))
    files = d.groupBy("key").agg(F.count_distinct("file").alias("n_files"))
    out = out.filter("n_targets > 1").join(files, "key").filter("n_files > 1")
    if multi_ok is not None:
        out = out.join(multi_ok.select(F.lower(F.trim("source_term")).alias("key")), "key", "left_anti")
    return out


QUOTED = r"[「“\"]([^「“”\"」]+)[」”\"]"


def replacement(suggestion: Column, issue: Column) -> Column:
    """struct(old_text, new_text) that an issue proposes, by four templates in order; or null."""
    both = F.concat_ws(" ", suggestion, issue)

    def pair(text: Column, pattern: str) -> Column:
        a, b = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
        return F.when((a != "") & (a != b), F.struct(a.alias("old_text"), b.alias("new_text")))

    new = F.regexp_extract(suggestion, rf"(?:改为|改成|修正为){QUOTED}", 1)
    quotes = F.filter(F.regexp_extract_all(issue, F.lit(QUOTED), 1), lambda q: (q != new) & F.length(q).between(2, 20))
    guessed = F.when((new != "") & (F.size(quotes) > 0), F.struct(F.get(quotes, F.lit(0)).alias("old_text"), new.alias("new_text")))
    return F.coalesce(
        pair(both, rf"将{QUOTED}(?:统[一—]|全部)?改[为譯成]{QUOTED}"), pair(both, rf"{QUOTED}(?:应为|应译为|建议改为|应改成){QUOTED}"),
        guessed, pair(issue, rf"{QUOTED}.*?应?译为{QUOTED}"),
    )


CONFIDENCE = ("low", "medium", "high")


def propagate(issues: DataFrame, paragraphs: DataFrame, key: str = "doc_id", least: str | None = None) -> DataFrame:
    """Paragraphs that have an issue's old text and are not flagged for it yet.

    ``issues`` has key, issue_pos, paragraph_index, old_text, new_text, severity. Of issues of one old text the first
    gives new text and severity. Case counts. With ``least``, issues of a lower or unknown confidence (null: medium)
    neither propagate nor flag, nor do those whose old text has one character or is the new one.
    """
    if least is not None:
        known = F.coalesce("confidence", F.lit("medium")).isin(*CONFIDENCE[CONFIDENCE.index(least) :])
        issues = issues.filter(known & (F.length("old_text") >= 2) & (F.col("old_text") != F.col("new_text")))
    first = F.row_number().over(Window.partitionBy(key, "old_text").orderBy("issue_pos"))
    patterns = issues.withColumn("_n", first).filter("_n = 1").select(key, "old_text", "new_text", "severity")
    hits = paragraphs.join(patterns, key).filter(F.col("text").contains(F.col("old_text")))
    return hits.select(key, "paragraph_index", "old_text", "new_text", "severity").join(issues.select(key, "paragraph_index", "old_text"), [key, "paragraph_index", "old_text"], "left_anti")


def pending(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """Distinct texts that the cache (key: SHA-256) lacks."""
    return texts.select(text).distinct().withColumn("key", cache_key(F.col(text))).join(cache.select("key"), "key", "left_anti")


def upsert_cache(cache: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Last write wins: rows of both, the one of highest ``written`` per key."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("written")))
    return cache.unionByName(new).withColumn("_n", last).filter("_n = 1").drop("_n")


def canonical_params(params: dict) -> str:
    """JSON of a call's parameters, keys in order at every depth, so that equal calls have equal keys."""
    import json

    return json.dumps(params, sort_keys=True, ensure_ascii=False)


def batches(texts: DataFrame, size: int, key: list[str], order: list) -> DataFrame:
    """``texts`` with batch_id per key: ``size`` consecutive rows in the given order."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return texts.withColumn("batch_id", F.floor((nth - 1) / F.lit(size)) + 1)


#: Rows a range whose places in the order say where ranges end.
SAMPLED = 20


def batches_of_all(texts: DataFrame, size: int, order: Column) -> DataFrame:
    """``texts`` with batch_id: ``size`` consecutive rows of the whole table in the given order.

    Rows are dealt into ranges and numbered within theirs; ranges begin where the counts of those before end. A row's
    range comes from its own place in the order alone, so that counting and numbering, however often and on however many
    tasks the plan is run, see the same ranges. They end at quantiles of the SAMPLED rows of least hash.
    """
    d = texts.withColumn("_o", order)
    ranges = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = F.sort_array(F.collect_list("_o"))
    every = F.greatest(F.lit(1), F.floor(F.size("_s") / ranges))
    ends = d.select("_o").orderBy(F.xxhash64("_o")).limit(SAMPLED * ranges).agg(some.alias("_s")).select(F.filter("_s", lambda x, i: (i > 0) & (i % every == 0)).alias("_ends"))
    dealt = d.crossJoin(F.broadcast(ends)).withColumn("_part", F.size(F.filter("_ends", lambda e: e <= F.col("_o")))).drop("_ends")  # one row
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per range
    first = counts.withColumn("_first", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("_o"))
    d = dealt.withColumn("_nth", nth).join(F.broadcast(first), "_part")
    return d.withColumn("batch_id", F.floor((F.col("_first") + F.col("_nth") - 1) / F.lit(size)) + 1).drop("_o", "_part", "_nth", "_first")


def chapters(paragraphs: DataFrame, key: str = "doc_id", top: int = 2) -> DataFrame:
    """``paragraphs`` with chapter_id: one starts at each heading of level ``top`` or higher, if the last has text."""
    by = Window.partitionBy(key).orderBy("para_index")
    heading = F.coalesce(F.col("heading_level") <= top, F.lit(False))
    first = F.lag("para_index").over(by).isNull()
    return paragraphs.withColumn("_b", (heading & ~first).cast("int")).withColumn("chapter_id", F.sum("_b").over(by) + 1).drop("_b")


def drop_blank_runs(paragraphs: DataFrame, most: int = 1, key: str = "doc_id") -> DataFrame:
    """Blank paragraphs beyond ``most`` in a row go."""
    by = Window.partitionBy(key).orderBy("para_index")
    blank = F.trim("text") == ""
    d = paragraphs.withColumn("_blank", blank).withColumn("_run", F.sum((~F.col("_blank")).cast("int")).over(by))
    nth = F.sum(F.col("_blank").cast("int")).over(Window.partitionBy(key, "_run").orderBy("para_index"))
    return d.withColumn("_nth", nth).filter((~F.col("_blank")) | (F.col("_nth") <= most)).drop("_blank", "_run", "_nth")


def with_context(paragraphs: DataFrame, key: str = "doc_id", cut: int = 200) -> DataFrame:
    """Distinct texts with what stands before and after, ``cut`` characters each; the last occurrence counts."""
    by = Window.partitionBy(key).orderBy("para_index")
    d = paragraphs.withColumns({"before": F.substring(F.coalesce(F.lag("text").over(by), F.lit("")), 1, cut), "after": F.substring(F.coalesce(F.lead("text").over(by), F.lit("")), 1, cut)})
    return d.groupBy(key, "text").agg(F.max_by(F.struct("before", "after"), "para_index").alias("c")).select(key, "text", "c.before", "c.after")


def repeated_rows(rows: DataFrame, key: str = "table_id", over: float = 0.8) -> DataFrame:
    """The first row of each table that is over ``over`` like the row before it."""
    by = Window.partitionBy(key).orderBy("row")
    d = rows.withColumn("like", word_overlap(F.coalesce(F.lag("text").over(by), F.lit("")), F.col("text"))).filter(F.col("like") > over)
    return d.groupBy(key).agg(F.min("row").alias("row"))


def merge_lines(lines: DataFrame, key: list[str], gap: float = 6, overlap: float = 10, order: str = "line") -> DataFrame:
    """Lines of a page (x0, y0, x1, y1, size, text) merged to paragraphs where they nearly touch and overlap.

    ``order`` is the page's own order of lines, so that columns side by side do not mix.
    """
    by = Window.partitionBy(*key).orderBy(order)
    near = (F.col("y0") - F.lag("y1").over(by) < gap) & (F.least("x1", F.lag("x1").over(by)) - F.greatest("x0", F.lag("x0").over(by)) > overlap)
    d = lines.withColumn("_new", (~F.coalesce(near, F.lit(False))).cast("int")).withColumn("paragraph", F.sum("_new").over(by))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda t: t["text"]), " ")
    return d.groupBy(*key, "paragraph").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg("size").alias("size"), text.alias("text"))


def lost_content(lines: DataFrame, others: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines (key, para_index, text) that the other version of their document (key, other) does not contain.

    A document's lines are taken together, so its other version comes once.
    """
    own = lines.groupBy(key).agg(F.collect_list(F.struct("para_index", "text")).alias("_l"))
    lost = F.filter("_l", lambda t: ~F.col("other").contains(t["text"]))
    return own.join(others.select(key, "other"), key).select(key, F.explode(lost).alias("_l")).select(key, "_l.*")


def fill_texts(issues: DataFrame, texts: DataFrame, keys: list[str], column: str = "source_text") -> DataFrame:
    """Empty values of a column filled from ``texts`` by key."""
    got = texts.select(*keys, F.col(column).alias("_fill"))
    return issues.join(got, keys, "left").withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit("")), F.col("_fill"), F.lit(""))).drop("_fill")
