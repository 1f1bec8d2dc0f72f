"""Context of a document: its domain, key terms, risky paragraphs and structure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import is_identifier
from lexiloom.operators.glossary import substring_matches
from lexiloom.operators.severity import by_domain
from lexiloom.operators.wordindex import phrase_counts, phrases, word_index

NO_DOMAIN = "通用技术文档"
# --- fixed values: marks of comparison, units and numbers that make a paragraph risky --------------------------------
COMPARISON = r"(?i)\b(?:versus|vs\.?|compared\s+(?:with|to)|rather\s+than|instead\s+of|contrary\s+to|as\s+opposed\s+to|unlike)\b"
UNIT = r"(?i)\b\d+\s*(?:mm|cm|m|kg|g|mg|mL|L|MHz|kHz|Hz|J|W|kV|V|mA|A|°C|°F|%)\b"
NUMBER = r"\b\d+(?:\.\d+)?\b"


# --- fixed values: words of a glossary's domains that speak for medical ones, and words of those domains --------------------
MEDICAL_WORDS, MEDICAL_DOMAINS = ("医学", "器械", "临床", "药物", "皮肤", "解剖", "影像"), ("医疗器械", "药物")


def detect_domain(docs: DataFrame, rules: DataFrame, key: str = "doc_id", terms: DataFrame | None = None) -> DataFrame:
    """The domain of most keyword hits per document, its confidence, and the runners-up over 0.3 of its hits.

    ``rules`` has domain, pos (order of domains) and pattern; it is a small table of rules and is broadcast. Every
    document is scored, also those without a hit. With ``terms`` (source, domain), each medical term of four characters or
    more that a document contains is a hit for every medical domain.
    """
    medical = F.lit(0)
    if terms is not None:
        of_word = lambda c, words: reduce(lambda a, b: a | b, [c.contains(w) for w in words])
        ours = terms.filter((F.length(F.trim("source")) >= 4) & of_word(F.coalesce("domain", F.lit("")), MEDICAL_WORDS)).select(F.lower(F.trim("source")).alias("source")).distinct()
        found = substring_matches(docs.select(key, "text"), ours, [key]).groupBy(key).agg(F.count("*").cast("int").alias("_medical"))
        docs = docs.join(found, key, "left")
        medical = F.coalesce("_medical", F.lit(0))
    packed = [(r["domain"], r["pos"], r["pattern"]) for r in rules.collect()]  # rules, not data
    by: dict[tuple, list[str]] = {}
    for domain, pos, pattern in packed:
        by.setdefault((pos, domain), []).append(pattern)
    low = F.lower("text")
    more = lambda d: medical if any(w in d for w in MEDICAL_DOMAINS) else F.lit(0)
    hits = F.array(*[F.struct(sum((F.regexp_count(low, F.lit("(?i)" + p)) for p in ps), more(d)).alias("hits"), F.lit(-pos).alias("order"), F.lit(d).alias("domain")) for (pos, d), ps in sorted(by.items())])
    d = docs.select(key, F.sort_array(hits, asc=False).alias("r"))
    top = F.element_at("r", 1)
    total = F.aggregate("r", F.lit(0), lambda a, x: a + x["hits"])
    second = F.transform(F.filter(F.slice("r", 2, 2), lambda x: x["hits"] > top["hits"] * 0.3), lambda x: x["domain"])
    none = top["hits"] == 0
    return d.select(
        key, F.when(none, NO_DOMAIN).otherwise(top["domain"]).alias("primary"), F.when(none, F.array().cast("array<string>")).otherwise(second).alias("secondary"),
        F.when(none, 0.0).otherwise(F.round(top["hits"] / F.greatest(total, F.lit(1)), 2)).alias("confidence"),
    )


def term_counts(paragraphs: DataFrame, terms: DataFrame, key: list[str]) -> DataFrame:
    """Word-bounded occurrences of each term per key, with the number of paragraphs that have it."""
    found = phrase_counts(word_index(paragraphs, [*key, "para_index"]), phrases(terms), [*key, "para_index"])
    return found.groupBy(*key, *terms.columns).agg(F.sum("count").alias("count"), F.count("*").alias("paragraphs"))


def key_terms(paragraphs: DataFrame, targets: DataFrame, terms: DataFrame, client: DataFrame | None = None, key: str = "doc_id", frequent: int = 3) -> DataFrame:
    """Key terms per document in two channels: ``frequent`` ones (30 at most) and rare but critical ones (50).

    ``paragraphs`` has key, para_index, text, heading_level, is_table_cell; ``targets`` key and the whole target text;
    ``terms`` source, target, domain, pos. A term counts by word-bounded occurrences; it is critical if a client asks
    for it, it is an identifier, it stands in a heading, one of the first three paragraphs or a table, occurs ten times
    or lacks its translation. Terms under four characters count only if a client's or an identifier.
    """
    mine = client.select(F.lower(F.trim("source")).alias("_low")).distinct() if client is not None else terms.limit(0).select(F.lower("source").alias("_low"))
    known = terms.withColumn("_low", F.lower(F.trim("source"))).join(mine.withColumn("_client", F.lit(True)), "_low", "left").withColumns({"_client": F.coalesce("_client", F.lit(False)), "_id": is_identifier(F.col("source"))})
    known = known.filter((F.col("source") != "") & (F.col("target") != "") & (F.col("_client") | F.col("_id") | (F.length("_low") >= 4)))
    at = [key, "para_index"]
    place = paragraphs.select(*at, F.col("heading_level").isNotNull().alias("heading"), (F.col("para_index") <= 3).alias("abstract"), F.coalesce("is_table_cell", F.lit(False)).alias("table"))
    hits = phrase_counts(word_index(paragraphs, at), phrases(known, "_low"), at).join(place, at)
    found = hits.groupBy(key, "source", "target", "domain", "pos", "_client", "_id").agg(F.sum("count").alias("count"), *[F.max(c).alias(c) for c in ("heading", "abstract", "table")])
    # a document's target is met once, by the array of its terms
    each = found.groupBy(key).agg(F.collect_list(F.struct(*[c for c in found.columns if c != key])).alias("_f")).join(targets.select(key, F.lower("target_text").alias("_t")), key, "left")
    missing = F.transform("_f", lambda f: f.withField("missing", ~F.coalesce(F.col("_t").contains(F.lower(F.trim(f["target"]))), F.lit(False))))
    found = each.select(key, F.explode(missing).alias("_f")).select(key, "_f.*")
    strong = [("_client", "client_mandated"), ("_id", "domain_critical"), ("heading", "heading_term"), ("abstract", "abstract_term"), ("table", "table_term")]
    why = F.concat_ws("|", *[F.when(F.col(c), F.lit(n)) for c, n in strong], F.when(F.col("count") >= 10, "high_frequency"), F.when(F.col("missing"), "translation_missing"))
    signal = F.col("_client") | F.col("_id") | F.col("heading") | F.col("abstract") | F.col("table")
    d = found.withColumn("why", why).withColumn("channel", F.when(F.col("count") >= frequent, "frequent").when(signal, "rare")).filter("channel is not null")
    order = Window.partitionBy(key, "channel").orderBy(
        F.when(F.col("channel") == "frequent", (F.col("why") == "").cast("int")).otherwise((~F.col("_client")).cast("int")),
        F.when(F.col("channel") == "rare", (~F.col("_id")).cast("int")), F.desc("count"), "pos",
    )
    d = d.withColumn("nth", F.row_number().over(order)).filter("nth <= if(channel = 'frequent', 30, 50)")
    return d.select(key, "channel", "nth", "source", F.col("target").alias("required_target"), "domain", F.col("count").cast("long").alias("count"), (F.col("why") != "").alias("is_critical"), F.when(F.col("missing"), "missing").otherwise("present").alias("translation_status"), F.when(F.col("why") == "", "frequency").otherwise(F.col("why")).alias("importance_reason"))


def risk_score(source: Column, target: Column, term_hits: Column) -> tuple[Column, Column]:
    """(score, reason) of a paragraph: numbers, key terms, length, comparisons and units."""
    n = F.regexp_count(source, F.lit(NUMBER)) + F.regexp_count(target, F.lit(NUMBER))
    long, compare, unit = (F.length(source) > 200) | (F.length(target) > 200), source.rlike(COMPARISON), source.rlike(UNIT)
    one = lambda c: c.cast("int")
    score = F.when(n >= 3, n * 3).otherwise(n) + F.when(term_hits >= 2, term_hits * 2).otherwise(0) + one(long) + 2 * one(compare) + one(unit)
    reason = F.concat_ws(
        "; ", F.when(n > 0, F.format_string("含 %d 个数字", n)), F.when(term_hits >= 2, F.format_string("含 %d 个关键术语", term_hits)),
        F.when(long, "超长句"), F.when(compare, "含比较逻辑"), F.when(unit, "含测量单位"),
    )
    return score, reason


def high_risk(pairs: DataFrame, terms: list[str], key: str = "doc_id", share: float = 0.15, least: int = 5) -> DataFrame:
    """The riskiest paragraphs per document: ``share`` of the scored ones, ``least`` or more, highest first.

    ``terms`` are the document's key terms, at most a few dozen.
    """
    low = F.lower("source_text")
    hits = sum((low.contains(t.lower()).cast("int") for t in sorted({t.lower() for t in terms})), F.lit(0))
    score, reason = risk_score(F.col("source_text"), F.col("target_text"), hits)
    d = pairs.filter(F.length(F.trim(F.concat("source_text", "target_text"))) >= 20).select(key, "para_index", score.alias("score"), reason.alias("reason")).filter("score > 0")
    cut = d.groupBy(key).agg(F.greatest(F.lit(least), F.floor(F.count("*") * share)).alias("cut"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "para_index"))
    return d.withColumn("nth", nth).join(cut, key).filter("nth <= cut").select(key, "para_index", "score", "reason", "nth")


def structure(paragraphs: DataFrame, key: str = "doc_id", shown: int = 20) -> DataFrame:
    """Headings, table cells and paragraphs that end without punctuation (the first ``shown`` of these), per document."""
    broken = (F.length("text") > 20) & ~F.col("text").rlike(r"[。！？.!?:：;；]\s*$") & F.col("heading_level").isNull()
    numbers = F.sort_array(F.collect_list(F.when(broken, F.col("para_index"))))
    return paragraphs.groupBy(key).agg(
        F.count("heading_level").alias("headings"), F.sum(F.coalesce("is_table_cell", F.lit(False)).cast("int")).alias("cells"),
        F.sum(broken.cast("int")).alias("broken"), F.slice(numbers, 1, shown).alias("broken_first"),
    )


# --- fixed values: checks that a domain asks for, and kinds of findings that ask for one beyond a number --------------------
DOMAIN_CHECKS = {
    "医疗器械注册": ("2.23", "4.3", "3.1", "1.4", "2.5"), "药物临床": ("3.1", "4.1", "2.23", "1.4", "2.6"), "网络安全评估": ("4.1", "2.23", "1.4", "2.12", "3.3"),
    "安全数据表": ("4.1", "3.1", "3.4", "1.2", "1.4"), "专利文献": ("1.1", "2.25", "1.4", "4.3"), "": ("1.4", "2.12", "3.1", "4.1"),
}
LIMITS = (("number_mismatches", 20, "3.1"), ("glossary_violations", 10, "4.1"), ("symbol_issues", 0, "3.3"), ("format_issues", 0, "5.1"))


def required_checks(docs: DataFrame, counts: DataFrame, key: str = "doc_id", primary: str = "primary") -> DataFrame:
    """``(key, check_id, why)``: checks that a document's domain asks for, then those that its mechanical findings ask for.

    ``docs`` has key and the primary domain, ``counts`` (key, kind, n). A check that the domain asks for is not asked for
    again; of several kinds that ask for one check the first counts.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame([(d, c) for d, checks in DOMAIN_CHECKS.items() for c in checks], "domain string, check_id string")
    asked = by_domain(docs, table, list(DOMAIN_CHECKS), key, primary).withColumn("why", F.lit("domain"))
    limits = spark.createDataFrame([(k, over, c) for k, over, c in LIMITS], "kind string, over long, check_id string")
    many = counts.join(F.broadcast(limits), "kind").filter("n > over").select(key, "check_id", F.col("kind").alias("why"))
    more = many.join(docs.select(key), key, "left_semi").join(asked, [key, "check_id"], "left_anti").groupBy(key, "check_id").agg(F.min("why").alias("why"))
    return asked.unionByName(more)


def mandatory_checks(domains: DataFrame, domain_checks: DataFrame, counts: DataFrame, limits: DataFrame) -> DataFrame:
    """Checks that a document must get: those of its domain, and those whose count passes its limit, each once.

    ``domains`` (doc_id, domain), ``domain_checks`` (domain, check_id), ``counts`` (doc_id, kind, n), ``limits`` (kind,
    over, check_id).
    """
    by_domain = domains.join(F.broadcast(domain_checks), "domain").select("doc_id", "check_id")
    by_count = counts.join(F.broadcast(limits), "kind").filter("n > over").select("doc_id", "check_id")
    return by_domain.unionByName(by_count).distinct()
