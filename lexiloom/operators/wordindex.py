"""Positional index of words, and phrases found by joins on consecutive places.

The index has a row per word of a text: its place, the word in lower case, and what stands between it and its
neighbours. A phrase is a word, or a chain of pairs (word, gap, next word): pairs that some phrase has are picked from the
index; where a phrase's rarest pair stands, the others must stand at the places before and after. Joins are as many for
ten words as for three; no pattern is compiled and no text is read again.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
NOT_WORD = r"[^\p{L}\p{N}_]+"


def words_of(low: Column) -> Column:
    return F.array_remove(F.split(low, NOT_WORD), "")


def gaps_of(low: Column) -> Column:
    """What stands before the first word, between words, and after the last: one more than there are words."""
    return F.split(low, WORD)


def _inner(words: Column, gaps: Column) -> Column:
    return F.slice(gaps, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))


def word_index(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``(key, place, before, word, gap, next, after)``: a row per word of each text, places from 0.

    ``before`` and ``gap`` are what stands between the word and the one before or after it, ``after`` what follows the next
    word up to another; null where there is none. ``key`` tells texts apart. Null texts have no words.
    """
    split = texts.select(*key, F.lower(text).alias("low")).select(*key, words_of(F.col("low")).alias("words"), gaps_of(F.col("low")).alias("gaps"))
    inner = split.select(*key, "words", _inner(F.col("words"), F.col("gaps")).alias("gaps"))
    rest = lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c), F.lit(1)))
    rows = F.arrays_zip(
        F.concat(F.array(F.lit(None).cast("string")), "gaps").alias("before"), F.col("words").alias("word"), F.col("gaps").alias("gap"), rest("words").alias("next"), rest("gaps").alias("after")
    )
    return inner.select(*key, F.posexplode(rows).alias("place", "w")).select(*key, "place", "w.before", "w.word", "w.gap", "w.next", "w.after").filter("word is not null")


#: Sides of joins with more characters than this are not broadcast.
BROADCAST_CHARS = 4 << 20


def dealt(d: DataFrame, small: bool) -> DataFrame:
    """A side of a join, broadcast if its size was checked; else both sides are shuffled, as sizes of texts are guesses."""
    return F.broadcast(d) if small else d.hint("merge")


#: Columns that :func:`phrases` adds to a term's own.
_OWN = ("_words", "_inner", "_n", "_lead", "_trail", "_core")


@dataclass
class Phrases:
    """Terms with their phrases: ``_core`` from first to last word in lower case, ``_n`` words, ``_lead`` and ``_trail``
    the signs around them. ``most`` is the largest number of words, ``signs`` and ``edges`` say whether some terms have
    no word, or signs around their words, ``small`` whether a broadcast may hold them."""

    table: DataFrame
    most: int
    signs: bool
    edges: bool
    small: bool

    def side(self, d: DataFrame) -> DataFrame:
        """A side of a join that comes from the terms."""
        return dealt(d, self.small)


def phrases(terms: DataFrame, source: str = "source") -> Phrases:
    """Terms taken apart. Blank ones are none and go. The shape is one row, aggregated from the terms."""
    low = F.lower(source)
    split = terms.filter(F.trim(F.coalesce(F.col(source), F.lit(""))) != "").withColumns({"_words": words_of(low), "_gaps": gaps_of(low)})
    table = split.withColumns({
        "_n": F.size("_words"), "_lead": F.get("_gaps", F.lit(0)), "_trail": F.element_at("_gaps", -1), "_inner": _inner(F.col("_words"), F.col("_gaps")),
        "_core": F.regexp_replace(low, rf"^{NOT_WORD}|{NOT_WORD}$", ""),
    }).drop("_gaps")
    edged = (F.col("_n") > 0) & (F.concat("_lead", "_trail") != "")
    shape = table.agg(F.max("_n").alias("most"), F.max(F.col("_n") == 0).alias("signs"), F.max(edged).alias("edges"), F.sum(F.length(source) + 64).alias("chars")).first()
    return Phrases(table, shape["most"] or 0, bool(shape["signs"]), bool(shape["edges"]), (shape["chars"] or 0) <= BROADCAST_CHARS)


_PHRASE = ["_core", "_lead", "_trail"]


def _pairs(table: DataFrame) -> DataFrame:
    """``(phrase, n, nth, pair, lead, trail)``: each pair of each distinct phrase, and the signs that must stand beside it."""
    at = F.posexplode(F.transform("_inner", lambda g, i: F.concat(F.get("_words", i), g, F.get("_words", i + 1)))).alias("nth", "pair")
    each = table.filter("_n > 1").dropDuplicates(_PHRASE).select(*_PHRASE, F.col("_n").alias("n"), at)
    ends = [F.when(F.col("nth") == 0, F.col("_lead")).otherwise("").alias("lead"), F.when(F.col("nth") == F.col("n") - 2, F.col("_trail")).otherwise("").alias("trail")]
    return each.select(*_PHRASE, "n", "nth", "pair", *ends)


def _fits(before: str, after: str, lead: str, trail: str) -> Column:
    """Signs around words stand there too, between the words and their neighbours, as ``\\b`` around a literal pattern asks."""
    side = lambda have, want: (F.col(want) == "") | F.col(have).eqNullSafe(F.col(want))
    return side(before, lead) & side(after, trail)


def phrase_places(index: DataFrame, terms: Phrases, key: list[str]) -> DataFrame:
    """``(key, place, columns of a term and its phrase)``: every place where a term's phrase begins.

    Terms without a word are not looked for. A phrase is sought where its rarest pair stands, by the pairs that phrases
    have in the index; its other pairs then have to stand at their places.
    """
    table = terms.table.drop("_words", "_inner")  # what stays of the phrase is taken off by the caller
    single = terms.side(table.filter("_n = 1").withColumnRenamed("_core", "word"))
    hits = index.join(single, "word").filter(_fits("before", "gap", "_lead", "_trail")).select(*key, "place", F.col("word").alias("_core"), *[c for c in table.columns if c != "_core"])
    if terms.most > 1:
        pairs = _pairs(terms.table)
        said = index.filter("gap is not null").select(*key, "place", F.concat("word", "gap", "next").alias("pair"), "before", "after")
        held = said.join(terms.side(pairs.select("pair").distinct()), "pair", "left_semi")
        if terms.most > 2:
            often = held.groupBy("pair").agg(F.count("*").alias("often"))
            led = pairs.join(often.hint("merge"), "pair").groupBy(*_PHRASE).agg(F.min_by(F.struct("n", "nth", "pair", "lead", "trail"), F.struct("often", "nth")).alias("p")).select(*_PHRASE, "p.*")
        else:
            led = pairs
        at = held.join(terms.side(led), "pair").filter(_fits("before", "after", "lead", "trail")).select(*key, (F.col("place") - F.col("nth")).alias("place"), *_PHRASE, "n", F.col("nth").alias("led"))
        found = at.filter("n = 2").select(*key, "place", *_PHRASE)
        if terms.most > 2:
            asked = at.filter("n > 2").join(terms.side(pairs.drop("n")), _PHRASE).filter("nth <> led").withColumn("at", F.col("place") + F.col("nth"))
            there = held.withColumnRenamed("place", "at").hint("merge")
            met = asked.join(there, [*key, "at", "pair"]).filter(_fits("before", "after", "lead", "trail"))
            found = found.unionByName(met.groupBy(*key, "place", *_PHRASE, "n").agg(F.count("*").alias("met")).filter("met = n - 2").select(*key, "place", *_PHRASE))
        hits = hits.unionByName(found.join(terms.side(table), _PHRASE))
    return hits


def _meets_itself(words: Column) -> Column:
    """Whether two occurrences of a phrase can share words: some of its first words are also its last."""
    n = F.size(words)
    return F.when(n > 1, F.exists(F.sequence(F.lit(1), n - 1), lambda k: F.slice(words, F.lit(1), k) == F.slice(words, n - k + 1, k))).otherwise(F.lit(False))


def phrase_counts(index: DataFrame, terms: Phrases, key: list[str]) -> DataFrame:
    """``(key, columns of a term, count)``: occurrences per text, from left to right without overlap.

    Only phrases that can overlap themselves need their places in order, at most those of one text. Terms that repeat in
    all columns count once.
    """
    marked = replace(terms, table=terms.table.dropDuplicates().withColumn("_self", _meets_itself(F.col("_words"))))
    hits = phrase_places(index, marked, key)
    columns = [c for c in terms.table.columns if c not in _OWN or c == "_n"]
    free = lambda a, p: F.when(p >= a["end"], F.struct((p + F.col("_n")).alias("end"), (a["n"] + 1).alias("n"))).otherwise(a)
    grouped = hits.groupBy(*key, *columns, "_self").agg(F.count("*").alias("_all"), F.sort_array(F.collect_list(F.when(F.col("_self"), F.col("place")))).alias("_places"))
    apart = F.aggregate("_places", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), free)["n"]
    return grouped.withColumn("count", F.when(F.col("_self"), apart).otherwise(F.col("_all"))).drop("_self", "_all", "_places", "_n")
