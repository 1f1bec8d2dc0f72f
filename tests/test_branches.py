"""Branches that no SQL holds: every check in one list, tables dealt to batches, term indexes in files, items of documents."""

from __future__ import annotations

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import procedural
from lexiloom.operators import glossary, mechanical, placement
from lexiloom.plans.queries import QUERIES
from lexiloom.sources import readers

PAIRS = [
    (1, "The valve is 25 °C, ISO 13485. It has 12 kilograms! Really? Yes. No.", "la valve 25 C. 12"), (2, "with 40 % and 3.5 of it, see page 7", "mit 41 %"), (3, "plain", "plain"), (4, None, "x"), (5, "the IPE", "klar"),
]


def as_rows(d) -> list:  # noqa: ANN001
    return sorted(map(tuple, d.select("id", "group", "type", "severity", "source_value", "target_value").collect()), key=repr)


def test_every_check_is_the_union_of_its_parts(spark):  # noqa: ANN001, ANN201
    pairs = spark.createDataFrame(PAIRS, "id int, source_text string, target_text string")
    terms = spark.createDataFrame([("the", "la", "通用"), ("valve", "Ventil", "d"), ("with", "avec", "other"), ("IPE", "x", "d")], "source string, target string, domain string")
    client = spark.createDataFrame([("IPE", "y")], "source string, target string")
    layout = spark.createDataFrame([(1, "table_rows", "low", 3, 4)], "id int, type string, severity string, source_n long, target_n long")
    text = lambda d, group: [(r.id, group, r.type, r.severity, r.source_value, r.target_value) for r in d.collect()]
    words = lambda d, kind=None: [(r.id, "client" if r.type.startswith("client") else "glossary", r.type, r.severity, r.source_term, r.expected_target) for r in d.collect() if kind in (None, r.type)]
    got = as_rows(mechanical.check_everything(pairs, ["id"], terms, client, "d", layout))
    want = text(mechanical.check_numbers(pairs, ["id"]), "numbers") + text(mechanical.check_symbols(pairs, ["id"]), "symbols") + text(mechanical.check_units(pairs, ["id"]), "units")
    want += [(r.id, "sentences", "sentence_count_mismatch", "low", str(r.source_sentences), str(r.target_sentences)) for r in mechanical.check_sentences(pairs, ["id"]).collect()]
    want += words(glossary.check_glossary(pairs, terms, ["id"], client, "d")) + [(1, "format", "table_rows", "low", "3", "4")]
    assert got == sorted(want, key=repr) and {w[1] for w in want} == {"numbers", "symbols", "units", "sentences", "glossary", "client", "format"}
    # pages: client terms do not cover general ones, and only they are critical
    got = as_rows(mechanical.check_everything(pairs, ["id"], terms, client, "d", pages=True))
    assert {g[1] for g in got} == {"numbers", "glossary", "client"} and {g[3] for g in got if g[1] != "client"} <= {"medium", "low"}
    assert (5, "client", "client_glossary_violation", "critical", "IPE", "y") in got and (5, "glossary", "glossary_violation", "low", "IPE", "x") in got and (1, "glossary", "glossary_violation", "medium", "valve", "Ventil") in got
    assert mechanical.check_everything(pairs.limit(0), ["id"], terms, client).count() == 0


def test_tables_go_where_they_overlap_or_to_the_least_loaded(spark):  # noqa: ANN001, ANN201
    rng, batches, tables, want = random.Random(6), [], [], []
    for d in range(25):
        mine = [(d, k, 10 * k, 10 * k + rng.randint(3, 12)) for k in range(1, rng.randint(1, 5) + 1)] if d != 7 else []
        asked = [(d, i, at, at + rng.randint(0, 4)) for i, at in enumerate(rng.randrange(0, 90) for _ in range(rng.randint(0, 9)))]
        load = {b[1]: 0 for b in mine}
        for _, i, a, z in asked:
            over = [b[1] for b in mine if b[2] <= z and b[3] >= a]
            if mine:
                at = over[0] if over else min(load, key=lambda k: (load[k], k))
                load[at] += 1
                want.append((d, at, i))
        batches += mine
        tables += asked
    b = spark.createDataFrame(batches, "doc_id int, batch_id long, para_start int, para_end int")
    t = spark.createDataFrame(tables, "doc_id int, table_index int, para_start int, para_end int").repartition(4)
    assert sorted(map(tuple, placement.attach_tables(b, t).collect())) == sorted(want) and len(want) > 60


def test_term_indexes_from_files(spark, tmp_path):  # noqa: ANN001, ANN201
    (tmp_path / "term_index_a.json").write_text(json.dumps({"file": "A.docx", "terms": {"heart": {"target": "心", "count": 3, "first_para": 1, "intra_file_conflict": True}}}, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "term_index_b.json").write_text(json.dumps({"terms": {"lung": {"target": "肺", "count": 1}, "x": {}}}, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "term_index_c.json").write_text("{broken", encoding="utf-8")
    (tmp_path / "other.json").write_text('{"terms": {"no": {"target": "n"}}}', encoding="utf-8")
    got = sorted(map(tuple, readers.term_index_files(spark, str(tmp_path)).collect()), key=repr)
    assert got == [("A.docx", "heart", "心", 3, 1, True), ("b", "lung", "肺", 1, None, None), ("b", "x", None, None, None, None)]


def test_split_documents_of_other_shapes(spark):  # noqa: ANN001, ANN201
    rows = [(1, '{"chapters": [{"paragraphs": []}, {"tables": [{"rows": [["a", null], [{"text": " b "}]]}]}]}'), (2, "[]"), (3, "no json"), (4, None), (5, '{"pages": [{"page_num": 1}, {"page_num": 2, "text": "x\\n\\ny"}]}')]
    got = sorted((r.id, r.para_index, r.text, r.table_index, r.row, r.col, r.page) for r in readers.split_paragraphs(spark.createDataFrame(rows, "id int, value string"), ["id"]).collect())
    assert got == [(1, 1, "a", 0, 1, 1, None), (1, 2, "b", 0, 2, 1, None), (5, 1, "x", None, None, None, 2), (5, 2, "y", None, None, None, 2)]


@pytest.mark.parametrize("order", [["one", "two", "three"], ["three", "one", "two"]])
def test_lines_merge_in_the_pages_own_order(spark, order):  # noqa: ANN001, ANN201
    from lexiloom.operators import crossdoc

    left = [("one", 0.0, 0.0, 50.0, 10.0), ("two", 0.0, 12.0, 50.0, 22.0), ("three", 100.0, 0.0, 150.0, 10.0)]
    at = {t: (t, *box) for t, *box in left}
    d = spark.createDataFrame([(1, k, *at[t], 9.0) for k, t in enumerate(order)], "page int, line int, text string, x0 double, y0 double, x1 double, y1 double, size double")
    assert {r.text for r in crossdoc.merge_lines(d, ["page"]).collect()} == {"one two", "three"}


def test_items_of_every_document(spark):  # noqa: ANN001, ANN201
    sf = "/root/testdata/sf0.001"
    texts = pd.read_parquet(f"{sf}/documents.parquet")
    want = [(i, x["category"], x["value"], x["position"]) for i, t in zip(texts["doc_id"], texts["text"], strict=True) for x in procedural.critical_items_of(t)]
    assert sorted(map(tuple, QUERIES["f06_critical_items"](spark, sf).collect())) == sorted(want)


def test_glossary_changes_need_no_order(spark):  # noqa: ANN001, ANN201
    from lexiloom.operators import report

    a = spark.createDataFrame([("Heart", "心", 1), ("heart ", "心脏", 2), ("lung", "肺", 3), ("x", None, 4)], "source string, target string, pos int")
    b = spark.createDataFrame([("heart", "心", 1), ("new", "新", 2), ("X", None, 3)], "source string, target string, pos int")
    got = sorted(map(tuple, report.glossary_changes(a, b).collect()))
    assert got == [("heart", "changed", "心脏", "心"), ("lung", "removed", "肺", None), ("new", "added", None, "新")]
    status = spark.createDataFrame([(1, "clean", None), (2, "has_issue", "x"), (None, None, None)], "paragraph_index int, status string, issue string")
    assert [r.issue for r in report.drop_status_only(status).collect()] == ["x"] and F is not None
