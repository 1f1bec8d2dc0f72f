"""Stand-ins for document pairs, glossaries and issues over the driver's tables, in Spark and as SQL for DuckDB.

The tables have no bilingual documents: a document and the next one serve as a pair, so do consecutive turns of a
conversation; short inline lists serve as glossaries and issue texts, the same on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators.constraints import CHECK_IDS
from lexiloom.sources.readers import lines, spread

TERMS = [
    (1, "the", "la", "通用"), (2, "of", "de", "法律"), (3, "and the", "et le", "医学"), (4, "tion", "sion", "通用"), (5, "is", "est", ""),
    (6, "der", "die", "德语"), (7, "que", "der", "通用"), (8, "in the", "dans", "法律"), (9, "for", "pour", "医学"), (10, "license", "licence", "法律"),
    (11, "with", "avec", "医学"), (12, "that", "dass", "德语"), (13, "licensed under", "sous licence", "法律"),
]
CLIENT = [("The", "le client"), ("With", "mit")]
CHECK_ITEMS = ["3.1 数值", "1.4 错译", "0.1 客户术语", "4.3 术语统一", "2.5 褒贬", "2.12 翻译腔", "2.6 近义词", "2.23 术语泛化", "2.2 标点", "5.1 格式", "1.2 增译", "2.3 标点风格", "2.18 冗余", "2.20", "Number check", "1.1 完整性", "2.9", "2.G3", "空格"]
ISSUE_TEXTS = ["含义改变", "术语不一致", "句子无法理解", "直译, 翻译腔", "成分缺失", "术语泛化", "括号不当", "过于口语", "空格多余", "可有可无", "语序", "无", "缺失且无法理解"]
TYPES = ["number_missing", "decimal_mismatch", "symbol_missing", "glossary_violation", "", "format_issue"]
SEVERITIES, CONFIDENCES = ["low", "medium", "critical"], ["high", "medium", "low", "medium"]
FILES = ["A.pdf", "A_CN.docx", "A_EN_US.docx", "B.docx", "C-ENG.docx", "~$A.docx", "D.xlsx", "D_FRA.xlsx", "e_DE.txt", "F_校对稿.docx", "G-EN-GB.docx", "G.pdf", "H.tmp", ".hidden.docx"]


#: Tables of whole texts, on which expressions are dear.
TEXTS = ("documents", "conversations", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(d) if name in TEXTS else d


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(table(spark, sf_dir, "documents"))


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("target_text"))
    return d.select("doc_id", F.col("text").alias("source_text")).join(after, "doc_id")


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target_text"))
    return c.select("conv_id", "turn", F.col("text").alias("source_text")).join(after, ["conv_id", "turn"])


def terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMS, "pos int, source string, target string, domain string")


def client_terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLIENT, "source string, target string")


def part_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a glossary: id, source (name), target (brand), domain (type)."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("source"), F.col("p_brand").alias("target"), F.col("p_type").alias("domain"))


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One issue per document, ten to a group ``doc``, its fields chosen by number."""
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        i.alias("issue_pos"), F.floor(i / 10).cast("long").alias("doc"), (i % 5).cast("int").alias("paragraph_index"), pick(TYPES, i).alias("type"),
        pick(CHECK_ITEMS, i * 7).alias("check_item"), pick(ISSUE_TEXTS, i * 5).alias("issue"), pick(SEVERITIES, i).alias("severity"), pick(CONFIDENCES, i).alias("confidence"),
        F.col("n_chars").cast("string").alias("source_value"), F.substring("text", 1, 40).alias("source_quote"), F.col("source").alias("dimension"),
    )


def _picked(values: list[str], i) -> F.Column:  # noqa: ANN001
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))


JUSTIFIED, SURE = ["changes_meaning", "style_preference", "because", ""], ["high", "sure", "low"]
JUDGED = ["confirmed", "false_positive", "unsure", "needs_context"]
EXPLAINED = ["术语库规定的译法在这里确实没有出现，译文需要按要求修改才行", "原文的数值与译文的数值一致，只是写法不同，因此这一条不是错误", "无"]


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review per ten documents, ``doc``: parts, fields and verdicts chosen by number, some missing, odd or too few."""
    i, doc = F.col("i"), F.col("doc")
    r = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), F.floor(F.col("doc_id") / 10).cast("long").alias("doc"), "lang", "source", F.substring("text", 1, 40).alias("q"))
    nth = i % 10
    told = (i % 4 != 3) & (doc % 7 != 0) & ((doc % 13 != 1) | (nth == 0)) & ((doc % 13 != 2) | (nth < 2)) & ((doc % 13 != 4) | (nth < 3))
    fields = {
        "paragraph_index": (i % 5).cast("string"), "dimension": F.col("source"), "check_item": _picked(CHECK_ITEMS, i * 7), "severity": _picked(["low", "medium", "critical", "high"], i * 3),
        "severity_justification": _picked(JUSTIFIED, i * 5), "confidence": _picked(SURE, i), "source_quote": F.col("q"), "target_quote": F.col("lang"), "issue": _picked(ISSUE_TEXTS, i * 5), "suggestion": F.col("source"),
    }
    issue = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])
    issue = F.when(i % 6 == 0, F.map_concat(issue, F.create_map(F.lit("comment"), F.lit("x")))).otherwise(issue)
    status = F.when(i % 97 == 0, "odd").when((i % 3 == 0) & (doc % 9 != 2), "has_issue").otherwise("clean")
    covered = F.struct(F.when(i % 83 == 0, nth + 100).otherwise(nth).cast("int").alias("paragraph_index"), status.alias("status"))
    verdict = F.struct(F.concat(F.lit("num_"), nth).alias("verdict_id"), F.when(doc % 6 == 0, "false_positive").otherwise(_picked(JUDGED, i)).alias("verdict"), _picked(EXPLAINED, i * (doc % 2)).alias("explanation"))
    some = lambda test, what: F.collect_list(F.when(test, what))
    d = r.groupBy("doc").agg(
        some(told, issue).alias("issues"), some(i % 41 != 0, covered).alias("paragraph_coverage"), some(i % 5 != 2, verdict).alias("verdicts"),
        some(i % 7 != 1, F.concat(F.lit("num_"), nth)).alias("expected_verdicts"), some(i.isNotNull(), nth.cast("int")).alias("own"),
    )
    ids = F.transform(F.array(*[F.lit(x) for x in CHECK_IDS]), lambda x, k: F.struct((k + 1).alias("k"), x.alias("id")))
    shown = F.filter(ids, lambda x: (x["k"] + doc) % 67 != 0)
    cover = F.map_from_entries(F.transform(shown, lambda x: F.struct(x["id"], F.struct(((x["k"] * 7 + doc) % 31 != 0).alias("checked"), ((x["k"] + doc) % 3).cast("int").alias("issues_found")))))
    longer = F.when(doc % 13 == 4, 199).when((doc % 13).isin(1, 2), 59)
    return d.select(
        "doc", F.when(doc % 5 == 0, None).when(doc % 11 == 0, "2.20").otherwise("2.21").alias("version"), F.when(doc % 23 != 5, cover).alias("dimension_coverage"),
        F.when(doc % 19 != 3, F.col("paragraph_coverage")).alias("paragraph_coverage"), "issues", "verdicts", F.when(longer.isNotNull(), F.sequence(F.lit(0), longer)).otherwise(F.col("own")).alias("expected_paragraphs"),
        F.when(doc % 8 != 0, F.col("expected_verdicts")).alias("expected_verdicts"), F.create_map(F.lit("number_mismatches"), doc % 2, F.lit("format_issues"), doc % 3).alias("found_before"),
    )


def _values(rows: list) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(repr(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows) + ")"


def _pick(values: list[str], i: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][1 + ({i}) % {len(values)}]"


#: SQL of the same stand-ins.
SQL = {
    "lines": "lines AS (SELECT doc_id, i AS para_index, trim(t) AS text FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(t) <> '')",
    "pairs": "pairs AS (SELECT a.doc_id, a.text AS source_text, b.text AS target_text FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)",
    "turns": "turns AS (SELECT a.conv_id, a.turn, a.text AS source_text, b.text AS target_text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)",
    "terms": f"terms(pos, source, target, domain) AS {_values(TERMS)}",
    "client": f"client(source, target) AS {_values(CLIENT)}",
    "files": f"files(filename) AS {_values(FILES)}",
    "parts": "parts AS (SELECT p_partkey AS id, p_name AS source, p_brand AS target, p_type AS domain FROM part)",
    "issues": f"""issues AS (SELECT doc_id AS issue_pos, doc_id // 10 AS doc, (doc_id % 5)::INT AS paragraph_index, {_pick(TYPES, 'doc_id')} AS type,
      {_pick(CHECK_ITEMS, 'doc_id * 7')} AS check_item, {_pick(ISSUE_TEXTS, 'doc_id * 5')} AS issue, {_pick(SEVERITIES, 'doc_id')} AS severity, {_pick(CONFIDENCES, 'doc_id')} AS confidence,
      n_chars::VARCHAR AS source_value, substring(text, 1, 40) AS source_quote, source AS dimension FROM documents)""",
}


SQL["reviews"] = f"""r AS (SELECT doc_id AS i, doc_id // 10 AS doc, doc_id % 10 AS nth, lang, source, substring(text, 1, 40) AS q FROM documents),
docs AS (SELECT DISTINCT doc, CASE WHEN doc % 13 = 4 THEN 199 WHEN doc % 13 IN (1, 2) THEN 59 END AS longer FROM r),
iss AS (SELECT *, i % 5 AS p, {_pick(["low", "medium", "critical", "high"], "i * 3")} AS severity, {_pick(JUSTIFIED, "i * 5")} AS just, {_pick(SURE, "i")} AS conf FROM r
  WHERE i % 4 <> 3 AND doc % 7 <> 0 AND (doc % 13 <> 1 OR nth = 0) AND (doc % 13 <> 2 OR nth < 2) AND (doc % 13 <> 4 OR nth < 3)),
cov AS (SELECT doc, CASE WHEN i % 83 = 0 THEN nth + 100 ELSE nth END AS p, CASE WHEN i % 97 = 0 THEN 'odd' WHEN i % 3 = 0 AND doc % 9 <> 2 THEN 'has_issue' ELSE 'clean' END AS status FROM r WHERE i % 41 <> 0 AND doc % 19 <> 3),
want AS (SELECT doc, nth AS p FROM r WHERE doc % 13 NOT IN (1, 2, 4) UNION ALL SELECT doc, unnest(range(0, longer + 1)) FROM docs WHERE longer IS NOT NULL),
ids(k, id) AS {_values(list(enumerate(CHECK_IDS, 1)))},
dim AS (SELECT doc, k, id, (k * 7 + doc) % 31 <> 0 AS checked, (k + doc) % 3 AS found FROM docs, ids WHERE (k + doc) % 67 <> 0 AND doc % 23 <> 5),
ver AS (SELECT doc, 'num_' || nth AS id, CASE WHEN doc % 6 = 0 THEN 'false_positive' ELSE {_pick(JUDGED, "i")} END AS verdict, {_pick(EXPLAINED, "(i * (doc % 2))")} AS said FROM r WHERE i % 5 <> 2),
sheet AS (SELECT doc, 'num_' || nth AS id FROM r WHERE i % 7 <> 1 AND doc % 8 <> 0)"""


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"


def sql_integers(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '[^a-zA-Z0-9]+'), lambda x: regexp_full_match(x, '\\d+'))"


def sql_decimals(text: str) -> str:
    return f"list_filter(regexp_extract_all({text}, '\\d+\\.\\d+[a-zA-Z0-9]*|[a-zA-Z0-9]+'), lambda x: regexp_full_match(x, '\\d+\\.\\d+'))"


def sql_percents(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '(?:^|[^a-zA-Z0-9])(\\d+(?:\\.\\d+)?)\\s*%', 1), lambda x: x::DOUBLE)"


def sql_has_word(text: str, source: str) -> str:
    """Whether a lower-cased text has a source of one word or more between word boundaries; for literal sources."""
    return f"regexp_matches(lower({text}), '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(lower({source})) || '($|[^\\p{{L}}\\p{{N}}_])')"
