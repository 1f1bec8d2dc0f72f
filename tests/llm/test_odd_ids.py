"""Null and equal ids in line dedup, and the whole pipeline on awkward tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexiloom.llm import linededup, simhash

PASSAGE = "The quick fox ran over the old stone bridge at dawn. It never looked back at the mill below. Nobody saw it again in that valley."


@pytest.mark.parametrize("ids", [[None] * 5, [7] * 5, [1, 2, 3, 4, 5], [None, 7, 7, None, 3]])
def test_one_of_several_texts_keeps_a_passage(spark, ids):  # noqa: ANN001, ANN201
    rows = [(i, f"Text number {n} begins in its own way here.\n\n{PASSAGE}\n\nAnd number {n} ends like nothing else, {n * 37}.") for n, i in enumerate(ids)]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    out = [r.text for r in linededup.dedup_lines(data).collect()]
    assert len(out) == 5 and sum("over the old stone bridge" in t for t in out) == 1 and sum("ends like nothing else" in t for t in out) == 5
    again = [r.text for r in linededup.dedup_lines(data.repartition(3)).collect()]
    assert sorted(again) == sorted(out)
    if ids[0] == 1:
        assert PASSAGE in next(t for t in out if "number 0" in t)


def test_near_dedup_of_clashing_names(spark):  # noqa: ANN001, ANN201
    data = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3, 4), (2, "a b c d e f", 1, 2, 3, 4), (2, "g h", 1, 2, 3, 4), (2, "g h", 1, 2, 3, 4)], "doc_id long, text string, rows int, kept_id int, `__lx_id` int, `a.b` int")
    out = simhash.keep_one(data)
    assert out.columns == data.columns and sorted(r.doc_id for r in out.collect()) == [1, 2]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `__lx_id` int, rows int, key string, found string"


def stages_of(spark, rows, tmp_path):  # noqa: ANN001, ANN201
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2, "k", "f") for i, t, s in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, int(i % 3 != 0), int(i % 5 == 0)) for i, _, _ in rows if i is not None] if rows else []
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        counts.append(out.count())
        docs = out
    return counts, pipeline.run(spark, str(tmp_path))


def test_pipeline_on_empty_tables(spark, tmp_path):  # noqa: ANN001, ANN201
    counts, out = stages_of(spark, [], tmp_path)
    assert counts == [0, 0, 0, 0] and out.count() == 0


def test_pipeline_on_odd_tables(spark, tmp_path):  # noqa: ANN001, ANN201
    plain = [(n, f"Document {n} says that item {n * 7919 % 1009} was seen on shelf {n * 31 % 97}, and that nobody had asked for it since.", "ab"[n % 2]) for n in range(30)]
    rows = [*plain, (None, None, None), (None, "no id, " + plain[0][1], "a"), (31, None, "a"), (32, "", None), (33, "   \n\t", "b"), (34, "long words " * 40_000, "b"), (34, "long words " * 40_000, "b")]
    counts, out = stages_of(spark, rows, tmp_path)
    assert counts[0] <= len(rows) and counts[0] >= counts[2] > 0 and counts[1] == counts[0]
    packed = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert packed.filter("n > 2048").count() == 0 and packed.count() > 0
