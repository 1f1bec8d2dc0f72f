"""Facts about functions and operators that the driver's tables do not show."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.functions import procedural, text
from lexiloom.operators import context, crossdoc, glossary, placement, severity
from lexiloom.plans.queries import QUERIES
from lexiloom.sources import readers


def col(spark, rows, expr):  # noqa: ANN001, ANN201
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], "s string").select(expr).collect()]


def test_numbers(spark):  # noqa: ANN001, ANN201
    assert col(spark, ["3.14"], text.numbers(F.col("s"), "integer")) == [["3", "14"]]
    assert col(spark, ["3.14", "a5 6b", "１２３"], text.numbers(F.col("s"), "decimal")) == [["3.14"], [], []]
    assert col(spark, ["１２３"], text.numbers(F.col("s"), "integer")) == [["１２３"]]
    assert col(spark, ["1至5, 2~3"], text.numbers(F.col("s"), "range")) == [["1至5", "2~3"]]


QUOTES = [  # text, quote, sentence around it, quote as fixed
    ("前句。这是一个完整的句子。后句", "完整", "这是一个完整的句子。", "这是一个完整的句子。"),
    ("前句。短句。后句", "短句。", "短句。", "短句。"),  # found, and complete
    ("一二三四五六七八九十一二三四五六。后", "二三四五六七八九十一二三四五六", "二三四五六七八九十一二三四五六。", "二三四五六七八九十一二三四五六"),  # found, and long
    ("甲乙。前面的几个字不同而后面的句子在。丙", "前面的几个字完全相同", "前面的几个字完全相同", "前面的几个字不同而后面的句子在。"),  # by its first five characters
    ("面积 5 m² 整。末", "m2", "m² 整。", "m² 整。"),
    ("甲；乙！丙", "乙", "乙！", "乙！"),
    ("全文没有它。", "缺", "缺", "缺"), ("", "x", "x", "x"), (None, "x", "x", "x"), ("甲。乙", "", "", ""),
    ("a.b. The end.", "The", "The", "The"), ("句一！句二。句三！句四", "句三", "句三！", "句三！"),
]


def test_quotes_grow_to_their_sentences(spark):  # noqa: ANN001, ANN201
    df = spark.createDataFrame([(i, t, q) for i, (t, q, _, _) in enumerate(QUOTES)], "i int, t string, q string")
    got = df.select("i", text.sentence_around(F.col("t"), F.col("q")).alias("s"), text.fixed_quote(F.col("t"), F.col("q")).alias("f")).orderBy("i").collect()
    assert [(r.s, r.f) for r in got] == [(s, f) for _, _, s, f in QUOTES]


def test_sentences_are_counted_by_their_breaks(spark):  # noqa: ANN001, ANN201
    rows = ["One. Two! Three?", "Dr. Who met Mr. X. They ran, e.g. fast. End", "  ", "one", "3.5 is. .5 too.", "一。二！三", "第3.版。又", "An animal. Next", None]
    want = [3, 3, 0, 1, 2, 3, 2, 1, 0]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    assert [r.n for r in df.select("i", text.sentence_count(F.col("t")).alias("n")).orderBy("i").collect()] == want


@given(st.lists(st.text(alphabet="abc", max_size=8), max_size=12), st.integers(1, 20))
def test_packed_lines_keep_text(lines: list[str], most: int) -> None:
    joined = "\n".join(lines)
    assert "\n".join(procedural.packed_lines(joined, most)).replace("\n", "") == joined.replace("\n", "")


def test_critical_items_claim_text() -> None:
    got = [(i["category"], i["value"]) for i in procedural.critical_items_of("pH at 25°C (77°F), CAS 50-00-0, USA, CO2, V1.2")]
    assert ("cas_number", "50-00-0") in got and ("chemical", "CO2") in got and ("version", "V1.2") in got
    assert not any(v == "USA" for _, v in got)
    assert procedural.critical_items_of(None) == []


def test_sequence_ratio(spark):  # noqa: ANN001, ANN201
    d = spark.createDataFrame([("abcd", "bcde"), (None, "x"), ("", "")], "a string, b string")
    got = [r[0] for r in d.select(procedural.sequence_ratio("a", "b")).collect()]
    assert got == [SequenceMatcher(None, "abcd", "bcde").ratio(), 0.0, 1.0]


def test_query_of_sequence_ratio_reads_whole_turns(spark, tmp_path):  # noqa: ANN001, ANN201
    texts = ["same words " * 60 + tail for tail in ("and one end", "with another tail " * 20, "")]
    spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r.ratio for r in QUERIES["f14_sequence_ratio"](spark, str(tmp_path)).collect()}
    assert got == {i: SequenceMatcher(None, texts[i], texts[i + 1]).ratio() for i in (0, 1)}


def test_enforce_is_sequential_and_literal(spark):  # noqa: ANN001, ANN201
    terms = F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in [("air", "$1\\x"), ("breathing air", "air mask"), ("", "z")]])
    r = spark.range(1).select(glossary.enforce(F.lit("Breathing AIR and air"), terms).alias("r")).first().r
    assert r.text == "$1\\x mask and $1\\x"
    assert [(t.source, t.n) for t in r.applied] == [("breathing air", 1), ("air", 2)]


def test_majority_needs_more_than_share(spark):  # noqa: ANN001, ANN201
    rows = [("a", "medium")] * 3 + [("a", "low")] + [("b", "medium")] * 3 + [("b", "low")] * 2 + [("c", "low"), ("c", "critical")]
    d = severity.majority(spark.createDataFrame(rows, "check_item string, severity string"))
    n = {(r[0], r[1]): r[2] for r in d.groupBy("check_item", "severity").count().collect()}
    assert n == {("a", "medium"): 4, ("b", "medium"): 3, ("b", "low"): 2, ("c", "low"): 1, ("c", "critical"): 1}


def test_style_items_are_never_critical(spark):  # noqa: ANN001, ANN201
    d = spark.createDataFrame([("2.3 数值", "x", "low"), ("2.20", "x", "critical"), ("9.9", "x", "medium")], "check_item string, issue string, severity string")
    got = [r[0] for r in d.select(severity.rule_severity(F.col("check_item"), F.col("issue"), F.col("severity"))).collect()]
    assert got == ["medium", "low", "medium"]


def test_key_terms_channels(spark):  # noqa: ANN001, ANN201
    paras = [(1, 1, "Intro about catheter", 1, False), (1, 2, "the valve opens", None, False), (1, 3, "third", None, False)] + [(1, i, "valve and pump pump", None, False) for i in range(4, 7)] + [(1, 7, "once stent, H319 and tube", None, False), (1, 8, "cell graft", None, True)]
    p = spark.createDataFrame(paras, "doc_id int, para_index int, text string, heading_level int, is_table_cell boolean")
    t = spark.createDataFrame([(i, s, s + "-zh", "d") for i, s in enumerate(["catheter", "valve", "pump", "stent", "H319", "tube", "graft", "absent", "the"])], "pos int, source string, target string, domain string")
    target = spark.createDataFrame([(1, "valve-zh pump-zh stent-zh h319-zh tube-zh")], "doc_id int, target_text string")
    client = spark.createDataFrame([("tube",)], "source string")
    got = {(r.channel, r.source): r for r in context.key_terms(p, target, t, client).collect()}
    assert {s for c, s in got if c == "frequent"} == {"valve", "pump"}
    assert got["frequent", "pump"]["count"] == 6
    assert {s for c, s in got if c == "rare"} == {"catheter", "tube", "H319", "graft"}
    assert got["rare", "tube"].nth == 1 and got["rare", "H319"].nth == 2
    assert got["rare", "catheter"].importance_reason == "heading_term|abstract_term|translation_missing"


def test_readers(spark, tmp_path):  # noqa: ANN001, ANN201
    (tmp_path / "g.csv").write_text("英文,中文\nheart,心\n,x\nlung,肺\n", encoding="utf-8-sig")
    assert {(r.source, r.target, r.domain) for r in readers.glossary_csv(spark, str(tmp_path / "g.csv")).collect()} == {("heart", "心", "通用"), ("lung", "肺", "通用")}
    assert readers.find_column(["No", "Source term", "Ziel"], readers.SOURCE_NAMES) == 1
    shapes = ['{"terms": {"a": {"source": "A", "target": "甲"}}}', '[{"source": "B", "target": "乙", "note": "n"}]', '{"C": "丙"}']
    got = readers.client_glossary_json(spark.createDataFrame([(s,) for s in shapes], "value string")).collect()
    assert {(r.source, r.target, r.note) for r in got} == {("A", "甲", ""), ("B", "乙", "n"), ("C", "丙", "")}
    (tmp_path / "t.txt").write_text("one\n\n two \n", encoding="utf-8")
    assert [(r.para_index, r.text) for r in readers.text_files(spark, str(tmp_path / "t.txt")).orderBy("para_index").collect()] == [(1, "one"), (3, "two")]
    assert spark.range(1).select(readers.ocr_text(F.lit('{"data": {"text": "x"}}'))).first()[0] == "x"


def test_merge_lines(spark):  # noqa: ANN001, ANN201
    rows = [(1, 0.0, 0.0, 100.0, 10.0, 9.0, "a"), (1, 0.0, 13.0, 100.0, 23.0, 9.0, "b"), (1, 0.0, 60.0, 100.0, 70.0, 9.0, "c")]
    d = spark.createDataFrame(rows, "page int, x0 double, y0 double, x1 double, y1 double, size double, text string")
    assert sorted(r.text for r in crossdoc.merge_lines(d, ["page"], order="y0").collect()) == ["a b", "c"]


def test_page_map_inherits(spark):  # noqa: ANN001, ANN201
    pages = spark.createDataFrame([(1, 1, "alpha beta gamma"), (1, 2, " "), (1, 3, "delta epsilon")], "doc_id int, page int, text string")
    paras = spark.createDataFrame([(1, i, t) for i, t in enumerate(["alpha beta", "gamma", "delta", "epsilon"], 1)], "doc_id int, para_index int, text string")
    got = {r.page: (r.first_index, r.last_index) for r in placement.page_map(pages, paras).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 4)}


def test_query_of_page_map_reads_whole_lines(spark, tmp_path):  # noqa: ANN001, ANN201
    head = "the same eighty characters and more begin every line of this document, one and all; "
    lines = [head + tail for tail in ("apples", "pears", "quince " * 9, "stone", "iron", "gold", "rain " * 9, "snow", "hail")]
    spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.page: (r.first_index, r.last_index) for r in QUERIES["j12_page_map"](spark, str(tmp_path)).collect()}
    want = {}
    for page in range(3):
        text_of = " ".join(lines[3 * page : 3 * page + 3])
        best = max(range(9), key=lambda i: (SequenceMatcher(None, text_of, " ".join(lines[i : i + 3])).ratio(), -i))
        want[page] = (best + 1, min(best + 3, 9))
    assert got == want == {0: (1, 3), 1: (4, 6), 2: (7, 9)}


def test_batches_fall_back_to_single_texts(spark):  # noqa: ANN001, ANN201
    d = spark.createDataFrame([("a",), ("b",), ("",)], "text string")
    got = {r.text: (r.translation, r.cacheable) for r in placement.reconcile_batches(d, lambda t: t.replace("\n<<<>>>\n", " ").replace("a", "A")).collect()}
    assert got == {"a": ("A", True), "b": ("b", False), "": ("", False)}


def test_canonical_params() -> None:
    assert crossdoc.canonical_params({"b": {"y": 1, "x": 2}, "a": 1}) == crossdoc.canonical_params({"a": 1, "b": {"x": 2, "y": 1}})
    assert crossdoc.canonical_params({"a": 1}) != crossdoc.canonical_params({"a": 2})


def test_stream_of_pairs(spark, tmp_path):  # noqa: ANN001, ANN201
    from lexiloom.streaming.pairs import check_stream

    spark.createDataFrame([(1, "costs 5", "kostet"), (2, "x", "y")], "doc_id int, source_text string, target_text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id int, source_text string, target_text string").parquet(str(tmp_path / "in"))
    check_stream(stream, ["doc_id"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [(r.doc_id, r.source_value) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "5")]


def test_entry_without_training_data_subpackage() -> None:
    """The rest never names the subpackage outside the guarded imports."""
    import lexiloom

    root = __import__("pathlib").Path(lexiloom.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"lexiloom\.llm|import llm", f.read_text(encoding="utf-8")), f
