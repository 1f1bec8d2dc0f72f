"""Cases of a few rows with the rows expected, as SQL: each against its function, see test_queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import procedural, text
from lexiloom.operators import crossdoc, glossary, mechanical, placement
from lexiloom.plans import tables as T
from lexiloom.plans.queries import _inline

CASES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CASE_SQL: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        CASES[f.__name__], CASE_SQL[f.__name__] = f, sql
        return f

    return add


_STYLES = [("heading 3", -1), ("Heading 1", -1), ("标题 2", -1), ("My heading", -1), ("Normal", 0), ("Normal", -1), ("Subheading 4b", -1)]


@query("SELECT * FROM (VALUES ('heading 3', -1, 3), ('Heading 1', -1, 1), ('标题 2', -1, 2), ('My heading', -1, 1), ('Normal', 0, 1), ('Normal', -1, NULL), ('Subheading 4b', -1, 4)) AS t(style, outline, level)")
def s03_heading_level(spark: SparkSession, sf: str) -> DataFrame:
    d = _inline(spark, _STYLES, "style string, outline int")
    return d.withColumn("level", text.heading_level(F.col("style"), F.when(F.col("outline") >= 0, F.col("outline"))))


_PAIRS = """WITH files(f, role, base, lang) AS (VALUES ('A.pdf', 'o', 'A', NULL), ('B.docx', 'o', 'B', NULL), ('D.xlsx', 'o', 'D', NULL), ('G.pdf', 'o', 'G', NULL),
  ('A_CN.docx', 't', 'A', 'zh'), ('A_EN_US.docx', 't', 'A', 'en'), ('C-ENG.docx', 't', 'C', 'en'), ('D_FRA.xlsx', 't', 'D', 'fr'), ('G-EN-GB.docx', 't', 'G', 'en'))
"""


@query(_PAIRS + "SELECT f AS filename, CASE role WHEN 'o' THEN 'original' ELSE 'translation' END AS role, lang AS lang_code FROM files")
def s16_scan_files(spark: SparkSession, sf: str) -> DataFrame:
    return crossdoc.scan_files(_inline(spark, T.FILES, "filename string")).select("filename", "role", "lang_code")


@query(T.with_("terms") + "SELECT * FROM terms WHERE domain IN ('法律', '通用', '')")
def p02_domain_filter(spark: SparkSession, sf: str) -> DataFrame:
    return glossary.for_domain(T.terms(spark), "法律")


_MERGE = [(1, "Heart", "心", "a", "f1", 2), (2, "heart ", "心脏", "a", "f2", 1), (3, "HEART", "心脏", "b", "f3", 0), (4, "heart", "心房", "b", "f4", 1), (5, "lung", "肺", "a", "f1", 2), (6, "lung", " 肺", "a", "f2", 1)]


@query("SELECT * FROM (VALUES ('heart', '心脏', 'f2', 2, 'use_new;keep_existing'), ('lung', '肺', 'f1', 0, '')) AS t(norm_key, target, from_file, n_conflicts, resolutions)")
def u05_merge_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    d = glossary.merge_glossaries(_inline(spark, _MERGE, "pos int, source string, target string, domain string, from_file string, priority int"))
    return d.select("norm_key", "target", "from_file", F.size("conflicts").alias("n_conflicts"), F.array_join(F.transform("conflicts", lambda c: c["resolution"]), ";").alias("resolutions"))


@query("SELECT * FROM (VALUES ('中文。中文！好', 3), ('你好.再见', 2), ('Dr. Who is here. Yes!', 2), ('  ', 0), ('Fig. 3 vs. Fig. 4', 1)) AS t(s, n)")
def f05_sentences_by_language(spark: SparkSession, sf: str) -> DataFrame:
    d = _inline(spark, ["中文。中文！好", "你好.再见", "Dr. Who is here. Yes!", "  ", "Fig. 3 vs. Fig. 4"], "s string")
    return d.select("s", text.sentence_count(F.col("s")).cast("int").alias("n"))


_ITEMS = ["Vapour pressure < 0.001 mm Hg @25°C", "See §1910.1200 and CAS 26007-43-2, mail a@b.org", "Call +1.703.527.3887 for CO2 at 95% V8.00"]


@query("""SELECT * FROM (VALUES (0, 'temperature', '@25°C', 30), (0, 'number_with_unit', '0.001 mm Hg', 18), (0, 'number_with_unit', '25°C', 31), (0, 'symbol', '<', 16), (1, 'regulation', '§1910.1200', 4), (1, 'cas_number', '26007-43-2', 23),
(1, 'email', 'a@b.org', 40), (2, 'phone', '+1.703.527.3887 ', 5), (2, 'percentage', '95%', 32), (2, 'chemical', 'CO2', 25), (2, 'version', 'V8.00', 36)) AS t(id, category, value, position)""")
def f06_critical_items(spark: SparkSession, sf: str) -> DataFrame:
    d = _inline(spark, list(enumerate(_ITEMS)), "id int, s string")
    return d.select("id", F.explode(procedural.critical_items("s")).alias("i")).select("id", "i.*")


@query("SELECT * FROM (VALUES ('A_CN.docx', 'zh', 'A'), ('A_EN_US.docx', 'en', 'A'), ('C-ENG.docx', 'en', 'C'), ('D_FRA.xlsx', 'fr', 'D'), ('e_DE.txt', 'de', 'e'), ('G-EN-GB.docx', 'en', 'G')) AS t(filename, lang_code, base_name)")
def f10_language_suffix(spark: SparkSession, sf: str) -> DataFrame:
    d = _inline(spark, T.FILES, "filename string").withColumn("s", text.language_suffix(F.col("filename")))
    return d.filter("s is not null").select("filename", "s.lang_code", "s.base_name")


@query("SELECT * FROM (VALUES ('前句。这是一个完整的句子。后句', '完整', '这是一个完整的句子。'), ('no such', '缺', '缺'), ('甲；乙！丙', '乙', '乙！')) AS t(s, fragment, sentence)")
def f15_sentence_around(spark: SparkSession, sf: str) -> DataFrame:
    d = _inline(spark, [("前句。这是一个完整的句子。后句", "完整"), ("no such", "缺"), ("甲；乙！丙", "乙")], "s string, fragment string")
    return d.withColumn("sentence", text.sentence_around(F.col("s"), F.col("fragment")))


@query("SELECT * FROM (VALUES ('前句。这是一个完整的句子。后句', '完整', '这是一个完整的句子。'), ('短。长句在这里', '短。', '短。'), ('x', '缺', '缺')) AS t(s, quote, fixed)")
def f16_fix_quotes(spark: SparkSession, sf: str) -> DataFrame:
    d = _inline(spark, [("前句。这是一个完整的句子。后句", "完整"), ("短。长句在这里", "短。"), ("x", "缺")], "s string, quote string")
    return d.withColumn("fixed", text.fixed_quote(F.col("s"), F.col("quote")))


_FIXES = [("将\"副反应\"统一改为\"不良反应\"", ""), ("", "「书面允许」应译为「书面许可」"), ("改为\"不良反应\"", "此处\"副反应\"不当"), ("", "无引号"), ("", "「甲」在此应译为「乙」")]


@query("SELECT * FROM (VALUES ('将\"副反应\"统一改为\"不良反应\"', '', '副反应', '不良反应'), ('', '「书面允许」应译为「书面许可」', '书面允许', '书面许可'), ('改为\"不良反应\"', '此处\"副反应\"不当', '副反应', '不良反应'), ('', '无引号', NULL, NULL), ('', '「甲」在此应译为「乙」', '甲', '乙')) AS t(suggestion, issue, old_text, new_text)")
def f17_replacement(spark: SparkSession, sf: str) -> DataFrame:
    d = _inline(spark, _FIXES, "suggestion string, issue string").withColumn("r", crossdoc.replacement(F.col("suggestion"), F.col("issue")))
    return d.select("suggestion", "issue", "r.old_text", "r.new_text")


@query("SELECT * FROM (VALUES ('say {\"a\": {\"b\": 1}} end}', '{\"a\": {\"b\": 1}}'), ('none', NULL), ('{open', NULL)) AS t(s, found)")
def f18_first_json(spark: SparkSession, sf: str) -> DataFrame:
    d = _inline(spark, ['say {"a": {"b": 1}} end}', "none", "{open"], "s string")
    return d.withColumn("found", text.first_json_object(F.col("s")))


@query("""SELECT * FROM (VALUES (512, '512 B'), (2048, '2.0 KB'), (5242880, '5.0 MB')) AS t(n, size)""")
def f24_human_size(spark: SparkSession, sf: str) -> DataFrame:
    return _inline(spark, [512, 2048, 5242880], "n int").withColumn("size", text.human_size(F.col("n")))


_CHECKED = [(1, "25 °C ± 1, ≥ 3, CAS 50-00-0, ISO 13485", "25 C +/- 1, >= 3"), (2, "α β, FDA 21", "α，beta中,文FDA 21"), (3, "5 kilograms in 3 hours", "5 千克 3 h"), (4, "plain", "plain")]


@query("SELECT * FROM (VALUES (1, 'symbol_missing', '°'), (1, 'symbol_missing', '±'), (1, 'cas_missing', 'CAS 50-00-0'), (1, 'regulation_missing', 'ISO 13485'), (2, 'symbol_missing', 'β'), (2, 'punctuation_mixed', NULL)) AS t(id, type, source_value)")
def j09_check_symbols(spark: SparkSession, sf: str) -> DataFrame:
    d = _inline(spark, [(i, a, b.replace("+/-", "+-")) for i, a, b in _CHECKED], "id int, source_text string, target_text string")
    return mechanical.check_symbols(d, ["id"]).select("id", "type", "source_value")


@query("SELECT * FROM (VALUES (3, 'full_unit_untranslated', '3 hours', '小时')) AS t(id, type, source_value, target_value)")
def j10_check_units(spark: SparkSession, sf: str) -> DataFrame:
    d = _inline(spark, _CHECKED, "id int, source_text string, target_text string")
    return mechanical.check_units(d, ["id"]).select("id", "type", "source_value", "target_value")


_IDS = ["H319", "CVE-2024-12345", "ISO 13485", "7732-18-5", "NCT12345678", "US12345678", "treatment", "h319", " EN 455 "]


@query("SELECT * FROM (VALUES ('H319', true), ('CVE-2024-12345', true), ('ISO 13485', true), ('7732-18-5', true), ('NCT12345678', true), ('US12345678', true), ('treatment', false), ('h319', false), (' EN 455 ', true)) AS t(term, critical)")
def p09_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    return _inline(spark, _IDS, "term string").withColumn("critical", text.is_identifier(F.col("term")))


@query("SELECT * FROM (VALUES ('{v1}', false), ('', false), ('  ', false), ('a {v1}', true), ('text', true)) AS t(s, keep)")
def p11_translatable(spark: SparkSession, sf: str) -> DataFrame:
    return _inline(spark, ["{v1}", "", "  ", "a {v1}", "text"], "s string").withColumn("keep", ~text.is_placeholder(F.col("s")))


@query(_PAIRS + """, n AS (SELECT base, count(*) AS n FROM files WHERE role = 't' GROUP BY base)
SELECT coalesce(o.base, t.base) AS base, o.f AS source_file, t.f AS target_file, CASE WHEN o.f IS NULL THEN 'orphan_translation' WHEN t.f IS NULL THEN 'orphan_original' WHEN n > 1 THEN 'duplicate' ELSE 'pair' END AS status
FROM (SELECT * FROM files WHERE role = 'o') o FULL JOIN (SELECT * FROM files WHERE role = 't') t ON o.base = t.base LEFT JOIN n ON n.base = t.base""")
def j03_pair_files(spark: SparkSession, sf: str) -> DataFrame:
    return crossdoc.pair_files(_inline(spark, T.FILES, "filename string")).select("base", "source_file", "target_file", "status")


_PLACES = [(1, 1, 1, "一二三四五六七八"), (1, 2, 2, "abc def"), (1, 3, 1, "甲乙丙丁 later"), (1, 4, 9, "nowhere"), (1, 5, 1, "")]


_PARAS = [(1, 1, "一二三四五六七八九"), (1, 2, "x"), (1, 3, "ab c d ef"), (1, 4, "有甲乙丙丁在"), (1, 9, "end")]


@query("SELECT * FROM (VALUES (1, 1, 1, 'prefix8'), (1, 2, 3, 'near squeezed'), (1, 3, 4, 'near chunk'), (1, 4, 9, 'bare'), (1, 5, 1, 'bare')) AS t(doc_id, quote_id, located, strategy)")
def j11_place_quotes(spark: SparkSession, sf: str) -> DataFrame:
    q = _inline(spark, _PLACES, "doc_id int, quote_id int, paragraph_index int, quote string")
    return placement.place_quotes(q, _inline(spark, _PARAS, "doc_id int, paragraph_index int, text string"))


_LOCATE = [(1, 1, "alpha"), (1, 2, "ALPHA"), (1, 3, "beta"), (1, 4, "alpha"), (1, 5, "zeta"), (1, 6, "gamma")]


@query("SELECT * FROM (VALUES (1, 1, 2, 5), (1, 2, 2, 6), (1, 3, 1, 1), (1, 4, 2, 5), (1, 5, NULL, NULL), (1, 6, 3, NULL)) AS t(doc_id, issue_pos, located_page, located)")
def j13_locate_on_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = _inline(spark, [(1, 1, "alpha beta"), (1, 2, "alpha"), (1, 3, "gamma")], "doc_id int, page int, text string")
    paras = _inline(spark, [(1, 1, [1]), (1, 2, [5, 6]), (1, 3, [])], "doc_id int, page int, paras array<int>")
    return placement.locate_on_pages(_inline(spark, _LOCATE, "doc_id int, issue_pos int, value string"), pages, paras).select("doc_id", "issue_pos", "located_page", "located")


@query("SELECT * FROM (VALUES (1, 1, 1), (1, 2, 2), (1, 2, 3), (1, 1, 4)) AS t(doc_id, batch_id, table_index)")
def j22_attach_tables(spark: SparkSession, sf: str) -> DataFrame:
    b = _inline(spark, [(1, 1, 1, 15), (1, 2, 16, 30)], "doc_id int, batch_id long, para_start int, para_end int")
    t = _inline(spark, [(1, 1, 3, 4), (1, 2, 90, 91), (1, 3, 20, 20), (1, 4, 99, 99)], "doc_id int, table_index int, para_start int, para_end int")
    return placement.attach_tables(b, t)
