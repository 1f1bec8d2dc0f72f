"""Glossaries: search, upsert, matching and enforcement.

Terms have columns source, target and, where used, domain, id, pos (their order), is_regex, case_sensitive.

Matching a glossary against texts is where data grows: terms x texts. Word-bounded matching goes by words: texts are
split once, and words, pairs of words and chains of pairs meet those of the terms in equi-joins. Substring and pattern
matching goes by character grams: a text is only searched for terms whose rarest gram it has.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from lexiloom.functions.procedural import longest_literal
from lexiloom.functions.text import norm_key
from lexiloom.operators.store import scratch_folder
from lexiloom.operators.wordindex import BROADCAST_CHARS, dealt, gaps_of, phrase_places, phrases, word_index, words_of

GENERAL = "通用"
EVERY_DOMAIN = "全部"
#: Terms up to this length are prone to false alarms.
SHORT = 3


def search_terms(terms: DataFrame, query: str = "", domain: str = EVERY_DOMAIN, page: int = 1, page_size: int = 50, pages: int = 1) -> DataFrame:
    """A page of the terms whose source or target contains ``query`` (any case), newest id first, with the total.

    With ``pages``, so many of them from ``page`` on.

    Row count and page come from one pass: the total is a window over the filtered rows' aggregate.
    """
    hit = terms.filter(F.lower("source").contains(query.lower()) | F.lower("target").contains(query.lower())) if query else terms
    if domain and domain != EVERY_DOMAIN:
        hit = hit.filter(F.col("domain") == domain)
    total = hit.agg(F.count("*").alias("total"))
    top = hit.orderBy(F.desc("id")).offset((page - 1) * page_size).limit(pages * page_size)
    return top.crossJoin(F.broadcast(total))  # one row


def for_domain(terms: DataFrame, domain: str | None, loading: bool = False) -> DataFrame:
    """Terms of a domain and general ones; when checking, also those without a domain."""
    if not domain:
        return terms
    return terms.filter(F.coalesce("domain", F.lit("")).isin(domain, GENERAL, *([] if loading else [""])))


def domain_counts(terms: DataFrame) -> DataFrame:
    return terms.groupBy("domain").agg(F.count("*").alias("n"))


def domain_shares(terms: DataFrame) -> DataFrame:
    n = terms.groupBy("domain").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("domain", "n", F.round(F.col("n") * 100.0 / F.col("total"), 1).alias("pct"))


def add_terms(terms: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` rows, with ``added`` false where (source, target) is in ``terms`` or earlier (by pos) in ``new``."""
    first = F.row_number().over(Window.partitionBy("source", "target").orderBy("pos")) == 1
    known = terms.select("source", "target", F.lit(True).alias("known")).dropDuplicates(["source", "target"])
    return new.withColumn("first", first).join(known, ["source", "target"], "left").select(*new.columns, (F.col("first") & F.col("known").isNull()).alias("added"))


def update_term(terms: DataFrame, term_id: int, **values: object) -> DataFrame:
    return terms.select(*[F.when(F.col("id") == term_id, F.lit(values[c]).cast(t)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c, t in terms.dtypes])


def delete_term(terms: DataFrame, term_id: int) -> DataFrame:
    return terms.filter(F.col("id") != term_id)


def standard_glossary(terms: DataFrame) -> DataFrame:
    """First row (by pos) per lower-cased, trimmed source; translated rows before those kept as they are, each sorted."""
    first = F.row_number().over(Window.partitionBy(F.lower(F.trim("source"))).orderBy("pos"))
    kept = terms.withColumn("_n", first).filter("_n = 1").drop("_n")
    return kept.withColumn("keep_as_is", F.col("source") == F.col("target")).orderBy("keep_as_is", F.lower("source"), "pos")


def export_terms(terms: DataFrame, domain: str | None = None, target_lang: str = "zh-CN") -> DataFrame:
    chosen = terms if not domain or domain == EVERY_DOMAIN else terms.filter(F.col("domain") == domain)
    return chosen.select("source", "target", F.lit(target_lang).alias("tgt_lng"), "domain", "id").orderBy("domain", "id")


def _entries(terms: DataFrame) -> DataFrame:
    return terms.select(norm_key(F.col("source")).alias("norm_key"), F.struct("pos", "source", "target", "domain", "from_file", "priority").alias("e"))


def _differs(e: Column, now: Column) -> Column:
    return F.coalesce(norm_key(e["target"]) != norm_key(now["target"]), F.lit(False))


def term_winners(terms: DataFrame) -> DataFrame:
    """``(norm_key, won)``: the entries that led each normalised source, one after another; the last is its winner.

    An entry takes the lead if its normalised target differs from the leader's and its priority number is lower. So a
    source has at most as many leaders as priorities, and that many rounds find them: each looks for the first entry that
    beats the leader, by an aggregate over all entries and a join with a row per source that may still change.
    """
    entries = _entries(terms)
    state = entries.groupBy("norm_key").agg(F.array(F.min("e")).alias("won"), F.min("e.priority").alias("least"))
    while True:
        now = F.element_at("won", -1)
        led = state.filter(F.col("least") < now["priority"]).select(F.col("norm_key").alias("_k"), now.alias("now"))
        if led.isEmpty():
            return state.drop("least")
        later = entries.join(led, F.col("norm_key").eqNullSafe(F.col("_k"))).filter((F.col("e") > F.col("now")) & (F.col("e.priority") < F.col("now.priority")) & _differs(F.col("e"), F.col("now")))
        after = later.groupBy("_k").agg(F.min("e").alias("next"))
        path = scratch_folder(terms.sparkSession)  # a row per source, so that rounds do not nest
        grown = F.when(F.col("next").isNull(), F.col("won")).otherwise(F.array_append("won", F.col("next")))
        state.join(after, F.col("norm_key").eqNullSafe(F.col("_k")), "left").select("norm_key", grown.alias("won"), F.when(F.col("next").isNotNull(), F.col("least")).alias("least")).write.parquet(path)
        state = terms.sparkSession.read.parquet(path)


def merge_winners(terms: DataFrame) -> DataFrame:
    """The columns of :func:`merge_glossaries` but the conflicts."""
    w = term_winners(terms).select("norm_key", F.element_at("won", -1).alias("now"))
    return w.select("norm_key", "now.source", "now.target", "now.domain", "now.from_file", "now.priority")


def merge_glossaries(terms: DataFrame) -> DataFrame:
    """One row per normalised source: the winner, and the conflicts met on the way.

    ``terms`` has source, target, domain, from_file, priority, pos (order of arrival). A newcomer whose normalised target
    differs from the present winner's is a conflict; it wins if its priority number is lower. Equal targets change
    nothing. A conflict names the winner of its moment. Only a source's list of conflicts comes together in one row.
    """
    won = term_winners(terms)

    def conflict(now: Column, e: Column, resolution: str) -> Column:
        return F.struct(
            now["target"].alias("existing_target"), now["from_file"].alias("existing_from"), e["target"].alias("conflicting_target"),
            e["from_file"].alias("conflicting_from"), F.lit(resolution).alias("resolution"),
        )

    leads = F.transform(F.slice("won", F.lit(2), F.size("won")), lambda e, i: F.struct(e.alias("e"), conflict(F.get("won", i), e, "use_new").alias("c")))
    taken = won.select("norm_key", F.inline(leads))
    e, now = F.col("e"), F.col("now")
    met = _entries(terms).join(won.withColumnRenamed("norm_key", "_k"), F.col("norm_key").eqNullSafe(F.col("_k"))).filter(~F.array_contains("won", e))
    met = met.select("norm_key", "e", F.element_at(F.filter("won", lambda w: w < e), -1).alias("now")).filter(_differs(e, now))
    each = taken.unionByName(met.select("norm_key", "e", conflict(now, e, "keep_existing").alias("c")))
    lists = each.groupBy(F.col("norm_key").alias("_k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("e", "c"))), lambda x: x["c"]).alias("conflicts"))
    w = won.select("norm_key", F.element_at("won", -1).alias("now")).join(lists, F.col("norm_key").eqNullSafe(F.col("_k")), "left")
    none = F.array().cast("array<struct<existing_target:string,existing_from:string,conflicting_target:string,conflicting_from:string,resolution:string>>")
    return w.select("norm_key", "now.source", "now.target", "now.domain", "now.from_file", "now.priority", F.coalesce("conflicts", none).alias("conflicts"))


def word_matches(texts: DataFrame, terms: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Pairs (key columns of a text, columns of a term) where the term stands in the text between word boundaries.

    Distinct words of a text, and its distinct pairs of neighbouring words if terms have two, meet terms in an equi-join.
    Longer terms, and those with signs at their ends, are followed through the positional index. Terms of signs alone
    are matched wherever a text contains them; blank ones are no terms. No text is read again, no pattern compiled.
    """
    known = phrases(terms)
    plain = F.concat("_lead", "_trail") == ""
    split = texts.select(*key, F.lower(text).alias("_low")).select(*key, words_of(F.col("_low")).alias("_w"), gaps_of(F.col("_low")).alias("_g"))
    said = F.col("_w")
    if known.most > 1:
        pair = F.transform(F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 1, F.lit(0))), lambda w, i: F.concat(w, F.get("_g", i + 1), F.get("_w", i + 1)))
        said = F.concat(said, pair)
    short = known.table.filter(F.col("_n").between(1, 2) & plain).select("_core", *terms.columns)
    met = split.select(*key, F.explode(F.array_distinct(said)).alias("_core")).join(known.side(short), "_core").drop("_core")
    if known.most > 2 or known.edges:
        rest = replace(known, table=known.table.filter((F.col("_n") > 2) | (F.col("_n") > 0) & ~plain))
        met = met.unionByName(phrase_places(word_index(texts, key, text), rest, key).select(*key, *terms.columns).distinct())
    if known.signs:
        signs = known.table.filter("_n = 0").select(*terms.columns).drop("case_sensitive")
        held = substring_matches(texts.select(*key, F.col(text).alias("text")), signs, key)
        met = met.unionByName(held, allowMissingColumns=True) if "case_sensitive" in terms.columns else met.unionByName(held)
    return met


#: Up to so many terms are searched for one after another in each text; more of them go by character grams.
FEW_TERMS = 64
#: Lengths of grams. A term goes by the longest of them that it has; the longer, the fewer texts share it.
GRAMS = (6, 3, 2, 1)
#: One text in so many says which grams are rare. It only chooses a term's gram; every text is searched.
COUNTED_SHARE = 16


def _folded(c: Column) -> Column:
    """Lower case in which a text contains whatever it contains as written: a final sigma is like any other."""
    return F.translate(F.lower(c), "ς", "σ")


def _grams(text: Column, sizes: list[int]) -> Column:
    """Distinct runs of so many characters, at every place."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1) for n in sizes]))


def gram_candidates(texts: DataFrame, needles: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``(key, columns of needles)``: pairs that share the needle's rarest gram, so all texts that contain it, and some others.

    ``needles`` has a column ``needle``, not blank, of any case; texts and needles are compared in folded case. Each needle
    stands under one gram, the one that fewest texts have; texts are dealt out as their distinct grams, and both meet
    in an equi-join, whatever the number of either.
    """
    own = F.col("_f")
    size = F.lit(GRAMS[-1])
    for n in GRAMS[-2::-1]:
        size = F.when(F.char_length(own) >= n, n).otherwise(size)
    folded = needles.withColumn("_f", _folded(F.col("needle"))).filter("_f <> ''")
    found = folded.groupBy(size.alias("size")).agg(F.sum(F.length("needle") + 64).alias("chars")).collect()  # a row per length
    sizes, small = sorted(r["size"] for r in found), sum(r["chars"] for r in found) <= BROADCAST_CHARS
    if not sizes:
        return _searched(texts, [], needles, key, text, None)
    grams = F.coalesce(*[F.when(size == n, _grams(own, [n])) for n in sizes])
    each = folded.select("needle", F.explode(grams).alias("_gram")).distinct()
    held = texts.select(*key, F.explode(_grams(_folded(F.col(text)), sizes)).alias("_gram"))
    counted = texts.filter(F.pmod(F.xxhash64(*key), F.lit(COUNTED_SHARE)) == 0).select(F.explode(_grams(_folded(F.col(text)), sizes)).alias("_gram")).groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = each.join(counted.hint("merge"), "_gram", "left").groupBy("needle").agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"))
    return held.join(dealt(folded.drop("_f").join(rarest, "needle"), small), "_gram").drop("_gram")


def _verified(texts: DataFrame, met: DataFrame, columns: list[str], key: list[str], text: str, holds) -> DataFrame:  # noqa: ANN001
    """Of candidates, those whose text ``holds`` them; a text comes once, to the array of its candidates."""
    listed = met.groupBy(*key).agg(F.collect_list(F.struct(*columns)).alias("_c"))
    side = texts.select(*key, F.col(text).alias("_text"), F.lower(text).alias("_low"))
    return side.join(listed, key).select(*key, F.explode(F.filter("_c", holds)).alias("_c")).select(*key, "_c.*")


def _searched(texts: DataFrame, rows: list[Row], terms: DataFrame, key: list[str], text: str, holds) -> DataFrame:  # noqa: ANN001
    """Each text against each of a few terms, which are literals of the expression, so their patterns are compiled once."""
    side = texts.select(*key, F.col(text).alias("_text"), F.lower(text).alias("_low"))
    if not rows:
        none = terms.schema.simpleString()
        return side.limit(0).select(*key, F.explode(F.array(F.lit(None).cast(none))).alias("_c")).select(*key, "_c.*")
    each = [F.when(holds(r), F.struct(*[F.lit(r[c]).cast(t).alias(c) for c, t in terms.dtypes])) for r in rows]
    return side.select(*key, F.explode(F.array_compact(F.array(*each))).alias("_c")).select(*key, "_c.*")


def _slices(rows: list[Row]) -> list[list[Row]]:
    return [rows[i : i + FEW_TERMS] for i in range(0, len(rows), FEW_TERMS)]


def substring_matches(texts: DataFrame, terms: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Pairs where the term's source occurs anywhere in the text, case as each term's case_sensitive says.

    ``key`` tells texts apart. Null texts hold no term, blank sources are no terms. Up to FEW_TERMS terms are searched for
    in every text; of more, a text is only searched for those whose rarest gram it has.
    """
    sensitive = "case_sensitive" in terms.columns
    known = terms.filter("source <> ''")
    some = known.limit(FEW_TERMS + 1).collect()
    if len(some) <= FEW_TERMS:
        return _searched(texts, some, terms, key, text, lambda r: F.col("_text").contains(r["source"]) if sensitive and r["case_sensitive"] else F.col("_low").contains(F.lower(F.lit(r["source"]))))
    exact = lambda t: F.coalesce(t["case_sensitive"], F.lit(False)) if sensitive else F.lit(False)
    holds = lambda t: F.when(exact(t), F.col("_text").contains(t["source"])).otherwise(F.col("_low").contains(F.lower(t["source"])))
    return _verified(texts, gram_candidates(texts, known.withColumn("needle", F.col("source")), key, text), terms.columns, key, text, holds)


def pattern_matches(texts: DataFrame, terms: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Pairs where the term's source, a pattern, is found in the text; in any case unless case_sensitive.

    A text is searched for a pattern only if it has the rarest gram of the longest literal that every match must hold.
    Patterns without such a literal are searched for in every text, FEW_TERMS in one pass.
    """
    known = terms.filter("source <> ''")
    some = known.limit(FEW_TERMS + 1).collect()
    free, out = some, None
    if len(some) > FEW_TERMS:
        led = known.withColumn("needle", longest_literal("source"))
        free = led.filter("needle = ''").drop("needle").collect()  # patterns such as \d+ alone
        pattern = lambda t: F.when(t["case_sensitive"], t["source"]).otherwise(F.concat(F.lit("(?i)"), t["source"]))
        out = _verified(texts, gram_candidates(texts, led, key, text), terms.columns, key, text, lambda t: F.regexp_like("_text", pattern(t)))
    for rows in _slices(free):
        hits = _searched(texts, rows, terms, key, text, lambda r: F.regexp_like("_text", F.lit(r["source"] if r["case_sensitive"] else "(?i)" + r["source"])))
        out = hits if out is None else out.unionByName(hits)
    return substring_matches(texts, terms.limit(0), key, text) if out is None else out


def match_glossary(texts: DataFrame, terms: DataFrame, key: list[str], domain: str | None = None, most: int | None = None) -> DataFrame:
    """Terms in texts: literal ones as substrings, ``is_regex`` ones as patterns; ``nth`` ranks a text's by length.

    With ``most``, a text's longest terms only, as for a prompt.
    """
    chosen = terms if not domain or domain == EVERY_DOMAIN else terms.filter(F.col("domain").isin(domain, GENERAL))
    both = substring_matches(texts, chosen.filter(~F.col("is_regex")), key).unionByName(pattern_matches(texts, chosen.filter("is_regex"), key))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(F.length("source")), "source"))
    ranked = both.withColumn("nth", nth)
    return ranked if most is None else ranked.filter(F.col("nth") <= most)


def check_glossary(pairs: DataFrame, terms: DataFrame, key: list[str], client: DataFrame | None = None, domain: str | None = None, strict_short: bool = False, severity: str = "critical") -> DataFrame:
    """Issues where a source text has a term whose target is missing from the target text.

    ``pairs`` has key columns, source_text and target_text. Client terms come first; a term they cover (same normalised
    source, found in the text) is not checked again. Short general terms count as low unless ``strict_short``.
    """
    known = for_domain(terms, domain).select("source", "target", F.coalesce("domain", F.lit("")).alias("domain"), F.lit(False).alias("mine"))
    if client is not None:
        known = known.unionByName(client.select("source", "target", F.lit("").alias("domain"), F.lit(True).alias("mine")))
    found = word_matches(pairs.select(*key, F.col("source_text").alias("text")), known, key)
    sev = F.lit(severity) if strict_short else F.when(F.length("source") <= SHORT, F.lit("low")).otherwise(F.lit(severity))
    issue = F.struct(
        F.when(F.col("mine"), "client_glossary_violation").otherwise("glossary_violation").alias("type"), F.col("source").alias("source_term"), F.col("target").alias("expected_target"), "domain",
        F.when(F.col("mine"), "critical").otherwise(sev).alias("severity"), "mine", norm_key(F.col("source")).alias("_key"),
    )
    # a text's terms are taken together: its target is met once, and what client terms cover is known
    each = found.groupBy(*key).agg(F.collect_list(issue).alias("_f"), F.collect_set(F.when(F.col("mine"), norm_key(F.col("source")))).alias("_covered"))
    missing = F.filter("_f", lambda f: ~F.col("_target").contains(F.lower(f["expected_target"])) & (f["mine"] | ~F.array_contains("_covered", f["_key"])))
    side = pairs.select(*key, F.lower("target_text").alias("_target"))
    return side.join(each, key).select(*key, F.explode(missing).alias("_f")).select(*key, *[f"_f.{c}" for c in ("type", "source_term", "expected_target", "domain", "severity")])


def _quoted(s: Column) -> Column:
    return F.concat(F.lit(r"(?iu)\Q"), F.replace(s, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def enforce(text: Column, terms: Column) -> Column:
    """struct(text, applied): each left-over source replaced by its target, longest source first, one after another.

    ``terms`` is an array of struct(source, target). What an earlier term inserts, a later one may replace.
    """
    ordered = F.array_sort(F.filter(terms, lambda t: (t["source"] != "") & (t["target"] != "")), lambda a, b: F.length(b["source"]) - F.length(a["source"]))
    literal = lambda s: F.regexp_replace(s, r"([\\$])", r"\\$1")

    def step(a: Column, t: Column) -> Column:
        n = F.size(F.split(a["text"], _quoted(t["source"]), -1)) - 1
        done = F.struct(t["source"].alias("source"), t["target"].alias("target"), n.alias("n"))
        return F.struct(F.regexp_replace(a["text"], _quoted(t["source"]), literal(t["target"])).alias("text"), F.when(n > 0, F.array_append(a["applied"], done)).otherwise(a["applied"]).alias("applied"))

    zero = F.struct(text.alias("text"), F.array().cast("array<struct<source:string,target:string,n:int>>").alias("applied"))
    return F.aggregate(ordered, zero, step)


def violations(text: Column, terms: Column) -> Column:
    """Of an array of struct(source, target): those whose source is still there or whose target is not, with severity."""
    still = lambda t: F.lower(text).contains(F.lower(t["source"]))
    bad = F.filter(terms, lambda t: (t["source"] != "") & (t["target"] != "") & (still(t) | ~text.contains(t["target"])))
    return F.transform(bad, lambda t: F.struct(t["source"].alias("source"), t["target"].alias("target"), still(t).alias("source_still_present"), F.when(still(t), "high").otherwise("medium").alias("severity")))


def post_process(texts: DataFrame, text: str, terms: str) -> DataFrame:
    """``texts`` with fixed text, applied terms, remaining violations, and whether all is perfect."""
    fixed = texts.withColumn("_fixed", enforce(F.col(text), F.col(terms))).withColumns({"fixed_text": F.col("_fixed.text"), "applied": F.col("_fixed.applied")}).drop("_fixed")
    return fixed.withColumn("violations", violations(F.col("fixed_text"), F.col(terms))).withColumn("perfect", F.size("violations") == 0)


def classify_terms(terms: DataFrame, keywords: DataFrame, least: int = 3) -> DataFrame:
    """``terms`` with the domain of highest keyword weight, its score and up to five signals.

    ``keywords`` has domain, domain_pos, lang (en: in the source, zh: in the target), weight, keyword, pos; the first
    domain wins ties; under ``least`` a term is general.
    """
    words = keywords.withColumnsRenamed({"domain": "kw_domain", "pos": "kw_pos"}).withColumn("source", F.col("keyword"))
    of = lambda column, asked: substring_matches(terms.select("id", F.col(column).alias("text")), words.filter(asked), ["id"])
    hit = of("source", F.col("lang") == "en").unionByName(of("target", F.col("lang") != "en"))
    signal = F.struct(F.when(F.col("lang") == "en", 0).otherwise(1), F.col("kw_pos"), F.concat(F.col("lang"), F.lit(":"), F.col("keyword"), F.lit("("), F.col("weight").cast("string"), F.lit(")")).alias("s"))
    per = hit.groupBy("id", "kw_domain", "domain_pos").agg(F.sum("weight").alias("score"), F.slice(F.sort_array(F.collect_list(signal)), 1, 5).alias("signals"))
    best = per.groupBy("id").agg(F.max_by(F.struct("kw_domain", "score", "signals"), F.struct("score", -F.col("domain_pos"))).alias("b"))
    enough = F.col("b.score") >= least
    return terms.join(best, "id", "left").select(
        "id", F.when(enough, F.col("b.kw_domain")).otherwise(F.lit(GENERAL)).alias("domain"), F.coalesce("b.score", F.lit(0)).cast("long").alias("score"),
        F.coalesce(F.array_join(F.transform("b.signals", lambda s: s["s"]), "; "), F.lit("")).alias("reason"),
    )
