"""Keyed stores under appends, compaction and readers; phases that are stopped midway."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructType

from lexiloom.operators import mechanical
from lexiloom.operators.store import KeyedStore, Phases, written

SCHEMA = StructType().add("k", IntegerType()).add("written", LongType()).add("v", StringType()).add("deleted", BooleanType())


def rows_of(d) -> dict:  # noqa: ANN001
    out = {r.k: (r.written, r.v) for r in d.collect()}
    assert len(out) == d.count()
    return out


def test_last_write_of_each_key(spark, tmp_path):  # noqa: ANN001, ANN201
    store, want, rng, at = KeyedStore(spark, f"{tmp_path}/s", SCHEMA, ["k"]), {}, random.Random(2), 0
    assert store.read().count() == 0 and store.read().columns == SCHEMA.names
    for turn in range(5):
        rows = []
        for _ in range(30):
            at += 1
            k, gone = rng.randrange(25), rng.random() < 0.2
            rows.append((k, at, f"v{at}", gone or None))
            want.pop(k, None)
            if not gone:
                want[k] = (at, f"v{at}")
        store.append(spark.createDataFrame(rows, SCHEMA))
        if turn in (1, 2, 4):
            store.compact()
        assert rows_of(store.read()) == want
    assert len([n for n in written(spark, store.folder) if n.startswith("snapshot-")]) == 2
    assert rows_of(store.read(F.col("written") > 120)) == {k: v for k, v in want.items() if v[0] > 120}
    store.compact(F.col("written") > 120)
    assert rows_of(store.read()) == {k: v for k, v in want.items() if v[0] > 120}


def test_readers_and_writers_during_compaction(spark, tmp_path, monkeypatch):  # noqa: ANN001, ANN201
    store = KeyedStore(spark, f"{tmp_path}/s", SCHEMA, ["k"])
    add = lambda *rows: store.append(spark.createDataFrame(list(rows), SCHEMA))
    add((1, 1, "a", None), (2, 2, "b", None))
    store.compact()
    before = store.read()
    add((1, 3, "c", None))
    # a delta that arrives after compaction has listed its deltas is not lost
    plain, late = store._last, []

    def last(rows):  # noqa: ANN001, ANN202
        if not late:
            late.append(add((2, 4, "d", None)))
        return plain(rows)

    monkeypatch.setattr(store, "_last", last)
    store.compact()
    assert rows_of(store.read()) == {1: (3, "c"), 2: (4, "d")}
    assert rows_of(before) == {1: (1, "a"), 2: (2, "b")}  # its files are still there
    # a snapshot without its mark, as a lost writer leaves it, is none
    spark.createDataFrame([(9, 9, "x", None)], SCHEMA).write.parquet(f"{store.folder}/snapshot-00000099")
    (tmp_path / "s" / "snapshot-00000099" / "_SUCCESS").unlink()
    assert 9 not in rows_of(store.read())


def test_a_phase_goes_on_where_it_stopped(spark, tmp_path):  # noqa: ANN001, ANN201
    pairs = spark.createDataFrame([(i, f"item {i} costs {i * 37}.5 and {i} %", f"item {i} costs {i * 37 if i % 3 else 0}.5") for i in range(60)], "doc_id long, source_text string, target_text string")
    check = lambda d: mechanical.check_numbers(d, ["doc_id"])
    count = lambda d: mechanical.severity_summary(d).withColumn("critical", F.col("critical").cast("long"))
    calls = []

    def stopped(d):  # noqa: ANN001, ANN202
        calls.append(1)
        if len(calls) == 4:
            raise KeyboardInterrupt
        return check(d)

    one = Phases(spark, f"{tmp_path}/p", buckets=6)
    one.start(pairs)
    with pytest.raises(KeyboardInterrupt):
        one.run("check", stopped)
    with pytest.raises(ValueError, match=r"lacks buckets \[3, 4, 5\]"):
        one.read("check")
    again = Phases(spark, f"{tmp_path}/p", buckets=6)
    assert again.start(pairs.limit(0)) == "input" and again.run("check", check) == [3, 4, 5] and again.run("check", check) == []
    got = again.read("check")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, check(pairs).collect()), key=repr) and got.count() > 30
    # the next phase reads what the first has written
    assert again.run("count", count, before="check") == list(range(6))
    total = lambda d: sorted(map(tuple, d.groupBy("type").agg(F.sum("total"), F.sum("critical")).collect()))
    assert total(again.read("count")) == total(count(check(pairs)))
    assert any("item" in line for line in (next((tmp_path / "p" / "check" / "00000").glob("part-*.json"))).read_text(encoding="utf-8").splitlines())
