"""The k-d tree and the ranker, written out as plain loops."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

from lexiloom.llm import quality, sharding

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n_shards", [2, 7, 16])
def test_tree_cuts_at_weighted_medians_of_the_widest_dimension(spark, monkeypatch, n_shards):  # noqa: ANN001, ANN201
    seen: dict = {}
    plain_points = sharding._points

    def points(*args):  # noqa: ANN002, ANN202
        out = plain_points(*args)
        seen.update({r.g: (r.w, tuple(r.ks)) for r in out.collect()})
        return out

    monkeypatch.setattr(sharding, "_points", points)
    monkeypatch.setattr(sharding, "_evened", lambda load, heavy: {})  # what the tree alone does
    rng = np.random.default_rng(n_shards)
    rows = [(i, "x" * int(rng.integers(50, 90)) + str(i), "abc"[i % 3], ["en", "de", None][i % 2]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.g: r.shard for r in sharding.kd_shards(docs, n_shards).join(docs.select("doc_id", F.md5("text").alias("g")), "doc_id").select("g", "shard").collect()}
    want: dict = {}

    def split(groups: list[str], a: int, b: int) -> None:
        if b - a <= 1:
            want.update(dict.fromkeys(groups, a))
            return
        mid, dims = (a + b) // 2, range(len(next(iter(seen.values()))[1]))
        along = lambda i: [seen[g][1][i] for g in groups]
        dim = max(dims, key=lambda i: (max(along(i)) - min(along(i)) if groups else 0, -i))
        asked, before, left = sum(seen[g][0] for g in groups) * (mid - a) / (b - a), 0, []
        for value in sorted(set(along(dim))):
            here = [g for g in groups if seen[g][1][dim] == value]
            w = sum(seen[g][0] for g in here)
            if before + w <= asked or (asked - before) * 2 > w:  # the nearer side of the group that holds the median
                left += here
            before += w
            if before > asked:
                break
        split(left, a, mid)
        split([g for g in groups if g not in set(left)], mid, b)

    split(sorted(seen), 0, n_shards)
    assert len(seen) == 300 and got == want


def plain_features(text: str) -> list[float]:
    words = regex.findall(r"[^\x20\x09-\x0D]+", text)
    n_chars, n_words = max(len(text), 1), max(len(words), 1)
    out = []
    for what in quality.COUNTS.values():
        pattern, unit = what if isinstance(what, tuple) else (what, "words")
        n = len(regex.findall(pattern.replace(r"\s", r"[ \t\n\x0B\f\r]") if "[^" not in pattern else pattern, text, flags=regex.V0))
        out.append(math.log1p(100 * n / (n_chars if unit == "chars" else n_words)))
    distinct = len(set(regex.split(r"[ \t\n\x0B\f\r]+", text)))
    return [*out, math.log1p(len(text) / n_words), math.log1p(len(words)), math.log1p(distinct) - math.log1p(n_words)]


def test_scores_are_those_of_a_plain_loop(spark):  # noqa: ANN001, ANN201
    docs, labels = pd.read_parquet(f"{SF}/documents.parquet"), pd.read_parquet(f"{SF}/labels.parquet")
    table = spark.read.parquet(f"{SF}/documents.parquet")
    ranker = quality.fit(table, spark.read.parquet(f"{SF}/labels.parquet"))
    own = {i: plain_features(t or "") for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    for r in table.select("doc_id", quality.feature_array(F.coalesce("text", F.lit(""))).alias("x")).collect():
        assert r.x == pytest.approx(own[r.doc_id], abs=1e-9), r.doc_id
    raw = {i: sum(w * x for w, x in zip(ranker.weights, xs, strict=True)) for i, xs in own.items()}
    for r in quality.score(table, ranker).collect():
        s = 1 / (1 + math.exp(ranker.threshold - raw[r.doc_id]))
        assert r.score == pytest.approx(s, abs=1e-9) and r.predicted == (s >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    # learnt from rows that are not held out: as many score under the threshold as are marked bad, and no direction lowers the loss of the pairs
    marked = [(int(i), int(q)) for i, q in zip(labels["doc_id"], labels["quality"], strict=True) if not pd.isna(q) and zlib.crc32(str(int(i)).encode()) % 3 != 1 and int(i) in own]
    assert sum(raw[i] < ranker.threshold for i, _ in marked) == sum(q == 0 for _, q in marked)
    x = np.array([own[i] for i, _ in marked])
    scale = x.std(axis=0)
    scale[scale < 1e-9] = np.inf
    good, bad = [i for i, q in marked if q], [i for i, q in marked if not q]
    d = np.array([(np.array(own[g]) - np.array(own[b])) / scale for g in good for b in bad])
    loss = lambda w: np.log1p(np.exp(-np.clip(d @ w, -500, 500))).mean() + 0.5e-3 * (w * w).sum()
    fitted = np.array([w * s if np.isfinite(s) else 0 for w, s in zip(ranker.weights, scale, strict=True)])
    at = loss(fitted)
    for k in range(len(fitted)):  # all pairs instead of the sampled ones, so up to their noise
        for by in (-0.5, 0.5):
            assert loss(fitted + by * np.eye(len(fitted))[k]) > at - 2e-3
