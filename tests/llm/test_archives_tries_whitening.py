"""Whitening, prefix tries and WARC archives against brute force, round trips, and on awkward tables."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import prefixtrie, warc, whitening
from lexiloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

# --- 11 whitening ----------------------------------------------------------------------------------------------------


def plain_whitening(vectors: list[list[float]], k: int = 8):  # noqa: ANN201
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    k = min(k, x.shape[1])
    return [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x], centred @ directions[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check_whitening(got: pd.DataFrame, ids: list, vectors: list[list[float]], k: int = 8) -> None:
    deviations, want, explained = plain_whitening(vectors, k)
    assert len(got) == want.size and (got["n"] == len(vectors)).all() and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    have = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert np.abs(have * np.sign((have * want).sum(axis=0)) - want).max() < 1e-8
    first = got[got["component"] == 1].set_index("vec_id").loc[ids]
    assert first["deviation"].tolist() == deviations
    assert np.allclose(got.drop_duplicates("component").sort_values("component")["explained"], explained, rtol=1e-9)


def test_whitening_query(spark):  # noqa: ANN001, ANN201
    rows = pd.read_parquet(f"{SF}/embeddings.parquet")
    check_whitening(QUERIES["op11_whitening"](spark, SF).toPandas(), rows["vec_id"].tolist(), [v.tolist() for v in rows["embedding"]])


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_whitening_tree_of_any_width(spark, parts):  # noqa: ANN001, ANN201
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(200, 5)) * [5, 4, 3, 2, 1] + [100, 0, -7, 3, 1]).tolist()
    data = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(parts)
    check_whitening(whitening.whiten(data, k=3).toPandas(), list(range(200)), vectors, 3)


def test_whitening_odd(spark):  # noqa: ANN001, ANN201
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 3.0], [1.5, -2.0, 0.25], [0.0, 7.0, 3.5], [0.0, 7.0, 3.5], [9.0, 1.0, -1.0]]
    bad = [None, [1.0, None, 2.0], [1.0, nan, 2.0], [inf, 0.0, 0.0], [-inf, 0.0, 0.0], []]
    schema = "vec_id long, embedding array<double>, x int, v string, n long, component int"
    rows = [(i, v, 1, "v", 2, 3) for i, v in enumerate(good)] + [(100 + i, v, 1, "v", 2, 3) for i, v in enumerate(bad)]
    data = spark.createDataFrame(rows, schema)
    check_whitening(whitening.whiten(data).toPandas(), list(range(5)), good)
    with_null_id = data.withColumn("vec_id", F.when(F.col("vec_id") != 4, F.col("vec_id")))
    got = whitening.whiten(with_null_id).toPandas()
    assert len(got) == 15 and got["vec_id"].isna().sum() == 3
    assert whitening.whiten(data.limit(0)).count() == 0 and whitening.whiten(data.filter("vec_id >= 100")).count() == 0
    # each length on its own
    two = spark.createDataFrame(rows[:5] + [(50 + i, [float(i * i), float(i)], 1, "v", 2, 3) for i in range(4)], schema)
    got = whitening.whiten(two).toPandas()
    check_whitening(got[got["vec_id"] < 50], list(range(5)), good)
    assert sorted(got[got["vec_id"] >= 50]["component"].unique()) == [1, 2] and (got[got["vec_id"] >= 50]["n"] == 4).all()


def test_whitening_without_variance(spark):  # noqa: ANN001, ANN201
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<float>")
    got = whitening.whiten(same).toPandas()
    assert len(got) == 8 and got["whitened"].isna().all() and (got["explained"] == 0).all() and (got["deviation"] == 0).all() and (got["identity_error"] == 0).all()
    few = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(few).toPandas()
    assert got[got["component"] == 1]["whitened"].abs().round(9).tolist() == [1, 1] and got[got["component"] > 1]["whitened"].isna().all()


def test_whitening_of_huge_entries(spark):  # noqa: ANN001, ANN201
    data = spark.createDataFrame([(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [0.5, 3.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(data).toPandas()
    assert len(got) == 6 and got[got["vec_id"] == 0]["deviation"].isna().all() and abs(got[(got["vec_id"] == 0) & (got["component"] == 1)]["whitened"].iloc[0]) == pytest.approx(1.5**0.5)


# --- 12 prefix trie --------------------------------------------------------------------------------------------------


def plain_trie(rows: list[tuple], share: bool = True) -> dict:
    """Nodes by their prefix; rows are (conv_id, turn, role, text), no two with the same conv_id and turn."""
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    rebuilt = {}
    for c, turns in own.items():
        first = c - (c % 5 if c >= 0 else -(-c % 5))
        h = zlib.crc32(str(c).encode()) % 9 if share else 0
        rebuilt[c] = tuple(own.get(first, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    out = {}
    for p, of in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = sorted(c for c in of if len(rebuilt[c]) == len(p))
        out[min(of), len(p)] = (
            min(members[p[:-1]]) if p else None, len(of), sum(len(q) == len(p) + 1 for q in below), sum(not any(len(r) > len(q) and r[: len(q)] == q for r in below) for q in below),
            sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def have_trie(df) -> dict:  # noqa: ANN001
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, digest string, family int, parent string"


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_brute_force(spark, seed):  # noqa: ANN001, ANN201
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-12, 60), 45):
        turns = rng.sample(range(20), rng.randint(1, 12))
        rows += [(c, None if i == 0 and rng.random() < 0.2 else t, rng.choice(["user", "bot", None]), rng.choice(["a", "", None, "ü😀", "a longer text"])) for i, t in enumerate(turns)]
    rng.shuffle(rows)
    data = spark.createDataFrame([(*r, 1, "d", 2, "p") for r in rows], CONVERSATIONS)
    assert have_trie(prefixtrie.trie(data)) == plain_trie(rows)
    assert have_trie(prefixtrie.trie(data, prefixtrie.no_turns)) == plain_trie(rows, share=False)


def test_trie_odd(spark):  # noqa: ANN001, ANN201
    data = spark.createDataFrame([(None, 0, "user", "no conversation", 1, "d", 2, "p"), (7, 0, None, None, 1, "d", 2, "p")], CONVERSATIONS)
    assert have_trie(prefixtrie.trie(data)) == plain_trie([(7, 0, None, None)])
    assert prefixtrie.trie(data.limit(0)).count() == 0 and prefixtrie.trie(data.filter("conv_id is null")).count() == 0
    # a role's end and a text's beginning don't run together
    data = spark.createDataFrame([(5, 0, "ab", "c", 1, "d", 2, "p"), (10, 0, "a", "bc", 1, "d", 2, "p")], CONVERSATIONS)
    assert {k: v[1] for k, v in have_trie(prefixtrie.trie(data)).items()} == {(5, 0): 2, (5, 1): 1, (10, 1): 1}
    # rows that repeat are turns of their own; ties in turn have one order
    again = [(5, 0, "u", "x", 1, "d", 2, "p"), (5, 0, "u", "x", 1, "d", 2, "p"), (10, 0, "u", "y", 1, "d", 2, "p"), (10, 0, "u", "x", 1, "d", 2, "p"), (15, 0, "u", "x", 1, "d", 2, "p"), (15, 0, "u", "y", 1, "d", 2, "p")]
    got = have_trie(prefixtrie.trie(spark.createDataFrame(again, CONVERSATIONS)))
    assert got[5, 2][1] == 1 and got[10, 2][1] == 2 and len(got) in (4, 5)


def test_trie_of_copies_and_long_conversations(spark):  # noqa: ANN001, ANN201
    """A third of all conversations are equal, one has 3,000 turns and others leave it anywhere: rows stay linear."""
    same = [(5 * c, t, "user", f"turn {t}") for c in range(400) for t in range(3)]
    long = [(10_000, t, "user", f"l{t}") for t in range(3_000)] + [(10_000 + 5 * k, t, "user", f"l{t}") for k in range(1, 8) for t in range(300 * k)]
    rows = same + long
    data = spark.createDataFrame([(*r, 1, "d", 2, "p") for r in rows], CONVERSATIONS).repartition(8)
    got = have_trie(prefixtrie.trie(data))
    assert got[0, 0][:4] == (None, 408, 2, 2) and got[0, 3][:2] == (0, 400)
    assert got[0, 3][5] == hashlib.sha256(",".join(str(5 * c) for c in range(400)).encode()).hexdigest()
    assert len(got) == 1 + 3 + 3_000 and got[10_000, 3_000][3] == 1 and got[10_000, 2_100][5] == hashlib.sha256(b"10035").hexdigest()
    assert got[10_000, 301][4] == sum(sum(300 * k >= d for k in range(1, 8)) * len(f"l{d - 1}") for d in range(301, 2_101))
    assert prefixtrie.prefixes(data).count() == 408 + len(rows)


def test_hashed_lists_in_pieces(spark, monkeypatch):  # noqa: ANN001, ANN201
    rows = [(bytes([k]), v) for k in range(3) for v in range(-50, 5000 * (k == 1) + 10)]
    data = spark.createDataFrame(rows, "key binary, value long").repartition(6)
    want = {bytes([k]): hashlib.sha256(",".join(str(v) for kk, v in rows if kk == bytes([k])).encode()).hexdigest() for k in range(3)}
    monkeypatch.setattr(prefixtrie, "_PIECE", 64)
    assert {bytes(r.key): r.sha256 for r in prefixtrie.hashed_lists(data, "key", "value").collect()} == want


# --- 13 WARC ---------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, path string, payload binary, `last` int, refers_to long"
BIG = "<p>" + "".join(chr(33 + i * i % 90) for i in range(1_500_000))
HTML = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>other ü😀</p>"), (3, None, "<p>same</p>"), (9, "http://a/9\r\nWARC-Type: evil", "<p>same</p>"), (4, "", None), (5, "http://a/5", ""),
    (6, "http://a/6", BIG), (7, "http://a/7", "line\r\n\r\nWARC/1.1\r\n\r\n\x00 end"), (None, "http://a/n", "<p>same</p>"), (None, "http://a/n", "only without an id"), (2, "http://a/2", "<p>other ü😀</p>"),
]


def page_table(spark, rows):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(*r, "p", b"x", 1, 2) for r in rows], PAGES)


def plain_pages(rows: list[tuple], least: int = 0) -> list[tuple]:
    last = {}
    for i, _, html in rows:
        h = html or ""
        last[h] = max(last.get(h, i) if last.get(h) is not None else i, i) if i is not None and last.get(h) is not None else (i if i is not None else last.get(h))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        to = last[html or ""] if len(data) >= least and last[html or ""] != i else None
        out.append((i, len(data), warc.base32_sha1(data), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5, 100])
def test_warc_round_trip(spark, tmp_path, least):  # noqa: ANN001, ANN201
    archives = warc.write_archives(page_table(spark, HTML).repartition(3), str(tmp_path), least)
    got = warc.read_archives(spark, archives, payloads=True).cache()
    assert sorted(map(tuple, warc.page_records(got).collect()), key=repr) == plain_pages(HTML, least)
    assert sum(r.records for r in archives.collect()) == len(HTML)
    responses = got.filter("record_type = 'response'").collect()
    assert sorted((bytes(r.payload) for r in responses), key=repr) == sorted(((h or "").encode() for i, _, h in HTML if (i, h) in {(p[0], h) for p in plain_pages(HTML, least) if p[3] == "response" and warc.base32_sha1((h or "").encode()) == p[2]}), key=repr)
    assert got.filter("record_type = 'revisit' and payload is not null").count() == 0 and got.filter("target_uri like 'http://a/9%'").first().target_uri == "http://a/9 WARC-Type: evil"


def test_warc_members_stand_alone(spark, tmp_path):  # noqa: ANN001, ANN201
    """Each offset begins a gzip member with the whole record; other tools read the archive as gzip."""
    archives = warc.write_archives(page_table(spark, HTML).coalesce(1), str(tmp_path), archive_bytes=600)
    rows = archives.collect()
    assert len(rows) > 2 and all(len(open(r.path, "rb").read()) == r.bytes for r in rows)
    for r in warc.read_archives(spark, archives).collect():
        data = open(r.path, "rb").read()
        one = zlib.decompressobj(31)
        text = one.decompress(data[r.offset :])
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n") and one.eof and f"WARC-Type: {r.record_type}".encode() in text
        assert text in gzip.decompress(data)


def test_warc_empty(spark, tmp_path):  # noqa: ANN001, ANN201
    archives = warc.write_archives(page_table(spark, HTML).limit(0), str(tmp_path))
    assert archives.count() == 0 and warc.page_records(warc.read_archives(spark, archives)).count() == 0


def _archive() -> bytes:
    return b"".join(warc.page_record(i, url, (html or "").encode(), None, "2020-01-01T00:00:00Z") for i, url, html in HTML[:4])


@pytest.mark.parametrize("chunk", [1, 7, 100, 1 << 18])
def test_warc_reader_in_chunks(chunk):  # noqa: ANN001, ANN201
    """Whatever the chunks, records are the same, without and with payloads."""
    got = list(warc.records(io.BytesIO(_archive()), payloads=True, chunk=chunk))
    assert [r["payload"].decode() for r in got] == [h for _, _, h in HTML[:4]] and [r["payload"] for r in warc.records(io.BytesIO(_archive()), chunk=chunk)] == [None] * 4


def test_warc_damage_is_found(spark, tmp_path):  # noqa: ANN001, ANN201
    data = _archive()
    ends = [r["offset"] for r in warc.records(io.BytesIO(data))]
    for broken in (data[:-5], data[: ends[2] + 20], data[: ends[1]] + b"junk" + data[ends[1] :], data[:ends[1] + 30] + bytes([data[ends[1] + 30] ^ 255]) + data[ends[1] + 31 :]):
        with pytest.raises(warc.DamagedArchive):
            list(warc.records(io.BytesIO(broken)))
    head = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("Content-Type", warc.HTTP_TYPE)]
    block = b"HTTP/1.1 200 OK\r\n\r\nabc"
    bad = {
        "digest": warc.record([*head, ("WARC-Payload-Digest", "sha1:" + warc.base32_sha1(b"abd"))], block), "length": gzip.compress(b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"),
        "longer": gzip.compress(b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 1\r\n\r\nabc\r\n\r\n"), "none": gzip.compress(b"WARC/1.1\r\nWARC-Type: x\r\n\r\nabc\r\n\r\n"),
        "no warc": gzip.compress(b"HTTP/1.1 200 OK\r\n\r\n"), "http": warc.record(head, block.replace(b"OK\r\n", b"OK\r\nContent-Length: 7\r\n")), "header": gzip.compress(b"WARC/1.1\r\nX: " + b"x" * 200_000),
    }
    for broken in bad.values():
        with pytest.raises(warc.DamagedArchive):
            list(warc.records(io.BytesIO(broken)))
    folded = gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\nwarc-target-uri: a\r\n  b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    (one,) = warc.records(io.BytesIO(folded), payloads=True)
    assert one["target_uri"] == "a b" and one["payload"] == b"abc" and one["payload_digest"] == warc.base32_sha1(b"abc")
    path = tmp_path / "cut.warc.gz"
    path.write_bytes(data[:-5])
    archives = spark.createDataFrame([(str(path),)], "path string")
    assert [r.record_type for r in warc.read_archives(spark, archives, strict=False).collect()] == ["response"] * 3 + ["damaged"]
    with pytest.raises(Exception, match="ends within"):
        warc.read_archives(spark, archives).collect()
