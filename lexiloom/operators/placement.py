"""Placing issues and quotes in documents: pages to paragraphs, values to paragraphs, quotes to paragraphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.procedural import best_windows, character_counts, lowest_grams, ratio_above
from lexiloom.functions.text import bound

#: Prefix lengths of a quote that are looked for, in order.
PREFIXES = (15, 10, 8, 5)
#: Neighbours that are searched when a quote's own paragraph lacks it: after, then before.
REACH = 5
#: Pages and windows whose character counts meet in one task.
BLOCK = 256
#: A document of up to so many blocks of pages, and of paragraphs, and so many characters of each, is searched in its row.
ROW_BLOCKS, ROW_CHARS = 4, 1 << 20
#: Length of the grams that lead from pages to paragraphs, and how many of a text are used.
GRAM, LOWEST = 6, 16


def _sizes() -> dict[str, Column]:
    """Paragraphs ``w`` of a window and ``step`` to the next one, from a document's ``n`` paragraphs and ``n_pages`` pages."""
    w = F.greatest(F.lit(2), F.floor(F.col("n") / F.col("n_pages"))).cast("int")
    return {"w": w, "step": F.greatest(F.lit(1), F.floor(w / 2)).cast("int")}


def _windows(pages: DataFrame, paragraphs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Paragraphs with the starts of the windows that hold them, and ``(key, start, combined, first_index, last_index)``.

    A paragraph goes to its own few windows, so a document of any length is no join of its own with itself.
    """
    n_pages = pages.groupBy(key).agg(F.count("*").alias("n_pages"))
    by = Window.partitionBy(key)
    numbered = paragraphs.select(key, "para_index", "text", (F.row_number().over(by.orderBy("para_index")) - 1).alias("i"), F.count("*").over(by).alias("n")).join(n_pages, key)
    sized = numbered.withColumns(_sizes())
    first = F.greatest(F.lit(0), F.floor((F.col("i") - F.col("w")) / F.col("step")).cast("int") + 1)
    starts = F.transform(F.sequence(first, F.floor(F.col("i") / F.col("step")).cast("int")), lambda k: (k * F.col("step")).cast("int"))
    placed = sized.select(key, "i", "para_index", "text", starts.alias("starts"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("i", "text"))), lambda x: x["text"])
    held = placed.select(key, "i", "para_index", "text", F.explode("starts").alias("start")).groupBy(key, "start")
    return placed, held.agg(F.array_join(texts, " ").alias("combined"), F.min("para_index").alias("first_index"), F.max("para_index").alias("last_index"))


#: The LOWEST smallest hashes of a text's runs of GRAM characters: what a text shares with its parts.
_lowest_grams = lowest_grams(GRAM, LOWEST)


def _seeds(filled: DataFrame, placed: DataFrame, key: str) -> DataFrame:
    """``(key, page, start)``: the window with most grams of a page in an inverted index of the document's paragraphs.

    A gram leads to the first paragraph that has it, so lines that repeat make no more rows.
    """
    index = placed.select(key, "i", "starts", F.explode(_lowest_grams(F.col("text"))).alias("gram")).groupBy(key, "gram").agg(F.min_by("starts", "i").alias("starts"))
    asked = filled.select(key, "page", F.explode(_lowest_grams(F.col("text"))).alias("gram"))
    hits = asked.join(index, [key, "gram"]).select(key, "page", F.explode("starts").alias("start")).groupBy(key, "page", "start").agg(F.count("*").alias("n"))
    return hits.groupBy(key, "page").agg(F.max_by("start", F.struct("n", -F.col("start"))).alias("start"))


def _even(d: DataFrame) -> DataFrame:
    """Rows dealt over as many tasks as a shuffle has: comparing costs far more than the bytes of a row tell."""
    return d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _matrix(counts: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(counts.to_pylist()), np.uint32).reshape(len(counts), -1).astype(np.int64)


def page_candidates(asked: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """``(key, page, start, least, seed)``: a page's ``seed``, and the windows that can still beat its ``least`` similarity.

    What can is told by the characters that both have, in any order. Only their counts meet, blocks of pages with
    blocks of windows. ``asked`` has key, page, least, seed, counts; ``windows`` key, start, counts.
    """

    def block(d: DataFrame, at: str, columns: list[str], name: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(key).orderBy(at)) - 1
        return d.withColumn("_b", F.floor(nth / BLOCK)).groupBy(key, "_b").agg(F.collect_list(F.struct(*columns)).alias(name)).drop("_b")

    pairs = block(asked, "page", ["page", "least", "seed", "counts"], "_p").join(block(windows, "start", ["start", "counts"], "_w").hint("merge"), key)
    kinds = {c: asked.schema[c].dataType.simpleString() for c in (key, "page")}

    def beat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ps, ws = b.column(1).slice(i, 1).flatten(), b.column(2).slice(i, 1).flatten()
                counts, start, seed, least = _matrix(ws.field("counts")), ws.field("start").to_numpy(), ps.field("seed").to_numpy(), ps.field("least").to_numpy()
                size, at, starts = counts.sum(axis=1), [], []
                for j, own in enumerate(_matrix(ps.field("counts"))):
                    total = size + own.sum()
                    most = np.where(total > 0, 2.0 * np.minimum(counts, own).sum(axis=1) / np.maximum(total, 1), 1.0)
                    can = start[(most > least[j]) | (most == least[j]) & (start < seed[j]) | (start == seed[j])]
                    at += [j] * len(can)
                    starts.append(can)
                if at:
                    of = pa.array(at, pa.int64())
                    columns = [b.column(0).take(pa.array([i] * len(at))), ps.field("page").take(of), pa.array(np.concatenate(starts)), ps.field("least").take(of), ps.field("seed").take(of)]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "page", "start", "least", "seed"])

    return _even(pairs.select(key, "_p", "_w")).mapInArrow(beat, f"{key} {kinds[key]}, page {kinds['page']}, start int, least double, seed int")


def _map_in_rows(filled: DataFrame, pages: DataFrame, paragraphs: DataFrame, key: str) -> DataFrame:
    """``(key, page, b)`` of documents that fit a row each: their paragraphs and pages come together in it."""
    of_pages = pages.groupBy(key).agg(F.count("*").alias("n_pages"))
    asked = filled.groupBy(key).agg(F.collect_list(F.struct("page", "text")).alias("_p"))
    texts = paragraphs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("para_index", "text"))).alias("_t"), F.count("*").alias("n"))
    rows = _even(texts.join(of_pages, key).join(asked, key).withColumns(_sizes()))
    found = rows.select(key, "_p", F.transform("_t", lambda t: t["para_index"]).alias("_i"), "w", best_windows("_p.text", "_t.text", "w", "step").alias("_f"))
    each = found.select(key, "_i", "w", F.explode(F.arrays_zip(F.col("_p.page").alias("page"), F.col("_f").alias("f"))).alias("x"))
    held = F.slice("_i", F.col("x.f.start") + 1, F.col("w"))
    b = F.struct(F.array_min(held).alias("first_index"), F.array_max(held).alias("last_index"), F.col("x.f.similarity").alias("similarity"))
    best = each.select(key, "x.page", b.alias("b"), F.struct("x.f.similarity", -F.col("x.f.start")).alias("order"))
    return best.groupBy(key, "page").agg(F.max_by("b", "order").alias("b"))


def _map_in_blocks(filled: DataFrame, pages: DataFrame, paragraphs: DataFrame, key: str) -> DataFrame:
    """``(key, page, b)`` of documents of any length.

    An index of grams names a window for each page, which is compared first; only windows that can still win, by their
    counts of characters and then by the longest sequence that both have in order, are compared after it.
    """
    placed, windows = _windows(pages, paragraphs, key)
    seeds = filled.join(_seeds(filled, placed, key), [key, "page"], "left").withColumnRenamed("start", "seed")
    first = seeds.join(windows.select(key, F.col("start").alias("seed"), "combined"), [key, "seed"], "left")
    # a page that shares no gram with its document begins with nothing
    ratio = F.when(F.col("combined").isNotNull(), ratio_above("text", "combined", F.lit(-1.0), F.lit(True))).otherwise(-1.0)
    asked = _even(first).select(key, "page", F.coalesce("seed", F.lit(-1)).alias("seed"), ratio.alias("least"), character_counts("text").alias("counts"))
    left = page_candidates(asked, windows.select(key, "start", character_counts("combined").alias("counts")), key)
    met = _even(left.join(filled, [key, "page"]).join(windows, [key, "start"]))
    is_seed = F.col("start") == F.col("seed")
    more = ratio_above("text", "combined", F.when(~is_seed, F.col("least")), F.col("start") < F.col("seed"))
    # what does not win is null and least in order: a filter would be moved before the rows are dealt, and compare twice
    scored = met.withColumn("similarity", F.coalesce(more, F.when(is_seed, F.col("least"))))
    best = scored.groupBy(key, "page").agg(F.max_by(F.struct("first_index", "last_index", "similarity"), F.struct("similarity", -F.col("start"))).alias("b"))
    return best.filter("b.similarity is not null")


def page_map(pages: DataFrame, paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per page the paragraphs of the window that is most like it: ``(key, page, first_index, last_index, similarity)``.

    Windows have max(2, paragraphs // pages) paragraphs and start at every half window; the first of the best wins. A
    blank page takes what the page before has. ``pages`` has key, page, text; ``paragraphs`` key, para_index, text.

    Documents of up to ROW_BLOCKS blocks of pages and of paragraphs are searched in a row each, longer ones by blocks. The result is that of comparing all.
    """
    filled = pages.filter(F.trim("text") != "").select(key, "page", "text")
    count = lambda d: d.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    sizes = count(paragraphs).unionByName(count(pages))
    long = sizes.filter((F.col("n") > ROW_BLOCKS * BLOCK) | (F.col("chars") > ROW_CHARS)).select(key).distinct()
    of = lambda how: [d.join(long, key, how) for d in (filled, pages, paragraphs)]
    best = _map_in_rows(*of("left_anti"), key).unionByName(_map_in_blocks(*of("left_semi"), key))
    all_pages = pages.select(key, "page").join(best, [key, "page"], "left")
    carried = F.last("b", ignorenulls=True).over(Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    return all_pages.withColumn("b", carried).select(key, "page", "b.first_index", "b.last_index", "b.similarity")


def locate_on_pages(issues: DataFrame, pages: DataFrame, page_paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Issues with the paragraph that their value leads to, or null.

    The value is looked for on pages as written, else in any case; of several pages the one with most paragraphs, the
    first of these, is taken; its paragraphs (array ``paras`` per page) are dealt in turn, in order of issue_pos.
    """
    pm = pages.join(page_paragraphs, [key, "page"], "left").withColumn("n", F.coalesce(F.size("paras"), F.lit(0)))
    hit = issues.filter(F.coalesce("value", F.lit("")) != "").join(pm, key).withColumn("exact", F.col("text").contains(F.col("value"))).filter(F.col("exact") | F.lower("text").contains(F.lower("value")))
    rank = F.row_number().over(Window.partitionBy(key, "issue_pos").orderBy(F.desc("exact"), F.desc("n"), "page"))
    at = hit.withColumn("_r", rank).filter("_r = 1").select(key, "issue_pos", "page", "paras")
    turn = F.row_number().over(Window.partitionBy(key, "page").orderBy("issue_pos")) - 1
    placed = at.withColumn("located", F.when(F.size("paras") > 0, F.get("paras", (turn % F.greatest(F.size("paras"), F.lit(1))).cast("int"))))
    return issues.join(placed.select(key, "issue_pos", F.col("page").alias("located_page"), "located"), [key, "issue_pos"], "left")


def first_paragraph(values: DataFrame, paragraphs: DataFrame, key: str = "doc_id", unique: bool = False) -> DataFrame:
    """The first paragraph that contains each value (key, value); with ``unique`` only if it is the only one."""
    mine = values.groupBy(key).agg(F.collect_set("value").alias("_values"))  # what is sought in one document, so that its paragraphs are not copied
    held = F.filter("_values", lambda v: F.col("text").contains(v))
    hit = paragraphs.join(mine, key).select(key, "paragraph_index", F.explode(held).alias("value"))
    out = hit.groupBy(key, "value").agg(F.min("paragraph_index").alias("paragraph_index"), F.count("*").alias("n"))
    return out.filter("n = 1") if unique else out


def sought_terms(issue_type: str = "type") -> Column:
    """What an issue without a place is looked for by, in order: its target and source term, or its number, that without
    leading zeros, and its whole part."""
    kind, value = F.col(issue_type), F.coalesce("source_value", F.lit(""))
    bare = F.regexp_replace(value, "^0+", "")
    number = F.array(value, F.when((bare != "") & (bare != value), bare), F.when(value.contains("."), F.substring_index(value, ".", 1)))
    terms = F.when(kind == "glossary_violation", F.array("expected_target", "source_term")).when(kind.isin("number_missing", "decimal_mismatch"), number)
    return F.filter(F.array_compact(F.coalesce(terms, F.array().cast("array<string>"))), lambda t: t != "")


def locate_by_type(issues: DataFrame, paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``issues`` with located and located_by: unplaced ones (paragraph_index under 1) get the first paragraph that holds the
    first of their terms that any paragraph holds; placed ones stay. ``issues`` has key, issue_pos, type, source_value,
    expected_target, source_term."""
    loose = issues.filter("paragraph_index < 1").select(key, "issue_pos", F.posexplode(sought_terms()).alias("nth", "value"))
    places = first_paragraph(loose.select(key, "value").distinct(), paragraphs, key)
    found = loose.join(places, [key, "value"]).groupBy(key, "issue_pos").agg(F.min_by(F.struct("paragraph_index", "value"), "nth").alias("at"))
    out = issues.join(found, [key, "issue_pos"], "left")
    return out.select(*[out[c] for c in issues.columns], F.coalesce("at.paragraph_index", "paragraph_index").alias("located"), F.col("at.value").alias("located_by"))


def _squeezed(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def _chunk(quote: Column) -> Column:
    """The longest run of four Chinese characters or more, '' if there is none."""
    runs = F.array_sort(F.regexp_extract_all(quote, F.lit(r"[一-鿿]{4,}"), 0), lambda a, b: F.length(b) - F.length(a))
    return F.coalesce(F.get(runs, F.lit(0)), F.lit(""))


#: How a paragraph can hold a quote, in order.
WAYS = [*(f"prefix{k}" for k in PREFIXES), "whole", "squeezed", "chunk"]


def _way(q: Column, t: Column) -> Column:
    """Number of the first of WAYS in which text ``t`` holds quote ``q``, or null."""
    chunk = _chunk(q)
    tests = [*[(F.length(q) >= k) & t.contains(F.substring(q, 1, k)) for k in PREFIXES], t.contains(q), _squeezed(t).contains(_squeezed(q)), (chunk != "") & t.contains(chunk)]
    out = F.when(tests[0], 0)
    for n, test in enumerate(tests[1:], 1):
        out = out.when(test, n)
    return out


def _best(rows: DataFrame, kept: list[str], rank: Column) -> DataFrame:
    """One row per quote: its columns, and ``hit``, the held place of least ``rank``; null if no place holds it."""
    place = F.when(F.col("way").isNotNull(), F.struct(rank.alias("rank"), "way", "at"))
    return rows.groupBy(*kept).agg(F.min_by(place, F.when(F.col("way").isNotNull(), F.struct(rank.alias("r"), "way", "at"))).alias("hit"))


def near_paragraphs(left: DataFrame, paragraphs: DataFrame, key: str) -> DataFrame:
    """Quotes with each paragraph up to REACH after theirs, then before: ``step`` counts them in the order of search."""
    steps = F.array(*[F.struct(F.lit(o).alias("off"), F.lit(n).alias("step")) for n, o in enumerate([*range(1, REACH + 1), *range(-1, -REACH - 1, -1)], 1)])
    asked = left.select("*", F.explode(steps).alias("s")).select(*left.columns, (F.col("paragraph_index") + F.col("s.off")).alias("at"), F.col("s.step").alias("step"))
    return asked.join(paragraphs, [key, "at"])


#: Characters of a quote that lead to the paragraphs of its document that may hold it.
ANCHOR = 4


def possible_paragraphs(left: DataFrame, paragraphs: DataFrame, key: str) -> DataFrame:
    """Quotes with each paragraph of their document that has the beginning of the quote, or of its Chinese run, blanks aside.

    Whatever way a paragraph holds a quote, it has one of these, so quotes meet paragraphs in an equi-join on them.
    """
    start = F.substring(_squeezed(F.substring("quote", 1, min(PREFIXES))), 1, ANCHOR)
    anchors = F.array_distinct(F.array_compact(F.array(start, F.when(_chunk(F.col("quote")) != "", F.substring(_chunk(F.col("quote")), 1, ANCHOR)))))
    asked = left.select("*", F.explode(anchors).alias("anchor"))
    text = _squeezed(F.col("text"))
    grams = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1) for n in range(1, ANCHOR + 1)]
    sizes = asked.groupBy(key).agg(F.collect_set(F.length("anchor")).alias("sizes"))  # at most ANCHOR + 1 a document
    of_size = [F.when(F.array_contains("sizes", n), g).otherwise(F.array().cast("array<string>")) for n, g in enumerate(grams, 1)]
    blank = F.when(F.array_contains("sizes", 0), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    held = paragraphs.join(sizes, key).select(key, "at", F.explode(F.array_distinct(F.concat(blank, *of_size))).alias("anchor"))
    pairs = asked.join(held, [key, "anchor"]).drop("anchor").distinct()
    return pairs.join(paragraphs, [key, "at"])


def place_quotes(quotes: DataFrame, paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Where each quote stands: ``(key, quote_id, located, strategy)``.

    Tried in order, in the quote's own paragraph: its first 15, 10, 8 or 5 characters, the whole quote, the quote
    without white space, its longest run of four Chinese characters or more; then these in the next five paragraphs and
    the five before, nearest first; then anywhere in the document, first paragraph first; else the paragraph itself,
    bare. ``quotes`` has key, quote_id, paragraph_index, quote; ``paragraphs`` key, paragraph_index, text. Each step
    only sees the quotes that the ones before have not placed.
    """
    texts = paragraphs.select(key, F.col("paragraph_index").alias("at"), "text")
    kept = [key, "quote_id", "paragraph_index", "quote"]
    way = _way(F.col("quote"), F.col("text"))
    ask = quotes.select(*kept).filter(F.length(F.coalesce("quote", F.lit(""))) > 0)
    own = _best(ask.join(texts, (ask[key] == texts[key]) & (ask["paragraph_index"] == texts["at"]), "left").select(*[ask[c] for c in kept], "at", way.alias("way")), kept, F.lit(0))
    left = own.filter("hit is null").drop("hit")
    near = _best(near_paragraphs(left, texts, key).withColumn("way", way), kept, F.col("step")).filter("hit is not null")
    left = left.join(near, [key, "quote_id"], "left_anti")
    found = possible_paragraphs(left, texts, key).withColumn("way", way).filter("way is not null")
    anywhere = _best(found, kept, F.col("at"))
    placed = None
    for d, scope in ((own.filter("hit is not null"), ""), (near, "near "), (anywhere, "document ")):
        one = d.select(key, "quote_id", F.col("hit.at").alias("at"), F.concat(F.lit(scope), F.get(F.array(*[F.lit(w) for w in WAYS]), F.col("hit.way"))).alias("strategy"))
        placed = one if placed is None else placed.unionByName(one)
    return quotes.join(placed, [key, "quote_id"], "left").select(key, "quote_id", F.coalesce("at", "paragraph_index").alias("located"), F.coalesce("strategy", F.lit("bare")).alias("strategy"))


def deal_in_turn(batches: DataFrame, entries: DataFrame, key: str = "doc_id", order: str = "entry") -> DataFrame:
    """Entries with the batch_id of their document that they are dealt to, one after another in order; documents without
    batches deal nothing."""
    ids = batches.groupBy(key).agg(F.array_sort(F.collect_set("batch_id")).alias("_ids"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    d = entries.withColumn("_nth", nth).join(ids, key)
    return d.withColumn("batch_id", F.get("_ids", (F.col("_nth") % F.size("_ids")).cast("int"))).drop("_nth", "_ids")


def attach_tables(batches: DataFrame, tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tables per batch: the first that overlaps their paragraphs; others go, one after another, to the batch with fewest.

    The last step depends on its own past: a document's tables, in order, are folded over the loads of its batches within
    its row. Both are few. Documents without batches attach nothing.
    """
    known = batches.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("batch_id", "para_start", "para_end"))).alias("_b"))
    asked = tables.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("table_index", "para_start", "para_end"))).alias("_t"))

    def step(a: Column, t: Column) -> Column:
        over = F.array_position(F.transform("_b", lambda b: (b["para_start"] <= t["para_end"]) & (b["para_end"] >= t["para_start"])), True)
        least = F.array_position(a["load"], F.array_min(a["load"]))
        return bound(F.when(over > 0, over).otherwise(least).cast("int"), lambda at: F.struct(F.transform(a["load"], lambda n, i: n + (i + 1 == at).cast("int")).alias("load"), F.array_append(a["at"], at).alias("at")))

    begun = F.struct(F.transform("_b", lambda b: F.lit(0)).alias("load"), F.array().cast("array<int>").alias("at"))
    dealt = asked.join(known, key).select(key, "_b", "_t", F.aggregate("_t", begun, step)["at"].alias("_at"))
    rows = dealt.select(key, "_b", F.explode(F.arrays_zip(F.col("_t").alias("t"), F.col("_at").alias("at"))).alias("x"))
    return rows.select(key, F.get("_b", F.col("x.at") - 1)["batch_id"].cast("long").alias("batch_id"), "x.t.table_index")


def reconcile_batches(texts: DataFrame, translate, separator: str = "\n<<<>>>\n", size: int = 30) -> DataFrame:  # noqa: ANN001
    """Translations of distinct texts, in batches joined by a separator: ``(text, translation, cacheable)``.

    ``translate`` maps a text to a text; a batch whose answer has another number of parts is sent one by one. What is
    empty or unchanged is not to be cached.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            todo = f["text"].tolist()
            todo.sort(key=len, reverse=True)
            out = []
            for at in range(0, len(todo), size):
                part = todo[at : at + size]
                got = translate(separator.join(part)).split(separator)
                if len(got) != len(part):
                    got = [translate(t) for t in part]
                out += [(t, g, bool(g) and g != t) for t, g in zip(part, got, strict=True)]
            yield pd.DataFrame(out, columns=["text", "translation", "cacheable"])

    return texts.select("text").distinct().mapInPandas(run, "text string, translation string, cacheable boolean")
