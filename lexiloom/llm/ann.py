"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each with a codebook of its own; a cell is a pair of centroids. A query walks through
cells in order of the summed distances of its halves, by a heap (the multi-sequence algorithm), until they hold enough
candidates; these are ranked by their exact cosine. Codebooks, and the share of vectors that is enough, are fitted on a
bounded sample; every vector is indexed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import discard, materialize

SAMPLE_ROWS = 20_000
#: The share of vectors that a query's cells hold is fitted: what covers REACHED of the true neighbours of FITTED sampled
#: vectors within the sample. Clustered vectors need a few per cent, vectors without structure a third.
REACHED, FITTED = 0.97, 400
MAX_CENTROIDS, PER_CENTROID = 256, 16
#: Rows that make a block of neighbouring cells, and queries of a block that meet them in one task.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 4_096


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, v)``: rows with an id whose vector is not null, empty or zero and has finite components only."""
    v = F.col("v")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & fine)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * x @ c.T


def cosines(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``x`` with ``v``, each summed in one order whatever other rows there are, to 14 places, so
    that multiples of one vector tie."""
    x, v = x / np.abs(x).max(axis=1, keepdims=True), v / np.abs(v).max()
    return np.round((x * v).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (v * v).sum()), 14)


def walk(d1: np.ndarray, d2: np.ndarray, held: np.ndarray, enough: int) -> list[int]:
    """Cells (i * len(d2) + j) by ascending d1[i] + d2[j] until they hold ``enough``; empty ones are passed over."""
    o1, o2, k = d1.argsort(kind="stable"), d2.argsort(kind="stable"), len(d2)
    s1, s2 = d1[o1], d2[o2]
    heap, out, got, done = [(s1[0] + s2[0], 0, 0)], [], 0, np.full(len(d1), -1)
    while heap and got < enough:
        _, i, j = heapq.heappop(heap)
        done[i] = j
        cell = int(o1[i]) * k + int(o2[j])
        if held[cell]:
            out.append(cell)
            got += int(held[cell])
        # a neighbour opens when both cells before it are done, so each is pushed once
        if i + 1 < len(d1) and done[i + 1] == j - 1:
            heapq.heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
        if j + 1 < k and (i == 0 or done[i - 1] >= j + 1):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
    return out


def enough_share(x: np.ndarray, c1: np.ndarray, c2: np.ndarray, k: int, reached: float = REACHED, fitted: int = FITTED) -> float:
    """The share of unit vectors ``x`` that cells hold, in a query's order, until they hold ``reached`` of its ``k`` nearest."""
    half, width = c1.shape[1], len(c2)
    cell = _distances(x[:, :half], c1).argmin(axis=1) * width + _distances(x[:, half:], c2).argmin(axis=1)
    held = np.bincount(cell, minlength=len(c1) * width)
    some = np.flatnonzero(held)
    need = []
    for i in np.random.default_rng(9).permutation(len(x))[:fitted]:
        s = x @ x[i]
        s[i] = -np.inf
        near = np.argsort(-s, kind="stable")[: min(k, len(x) - 1)]
        d1, d2 = _distances(x[i : i + 1, :half], c1)[0], _distances(x[i : i + 1, half:], c2)[0]
        order = some[np.argsort(d1[some // width] + d2[some % width], kind="stable")]
        before = np.zeros(len(held))
        before[order] = np.cumsum(held[order])
        need += (before[cell[near]] / len(x)).tolist()
    return float(np.quantile(need, reached)) if need else 1.0


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", share: float | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of highest cosine found for each row of ``queries``.

    Candidates are all usable rows of ``vectors`` of the query's length but those with its own id; fewer than k give
    fewer rows; ties go to the smaller id. Rows that repeat id and vector count once. Null, zero or non-finite vectors and
    null ids take no part; empty tables give an empty one; other columns are not looked at. Each length of vectors, of
    which there are few, is a search of its own. ``share`` of the vectors are candidates; by default it is fitted.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    rows, asked = usable(vectors, id_col, vec_col).dropDuplicates(["id", "v"]), usable(queries, id_col, vec_col).dropDuplicates(["id", "v"])
    lengths = [r["n"] for r in asked.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]
    out = None
    for dim in lengths:
        found = _search(rows.filter(F.size("v") == dim), asked.filter(F.size("v") == dim), dim, k, share)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    return vectors.sparkSession.createDataFrame([], schema) if out is None else out


def _search(rows: DataFrame, asked: DataFrame, dim: int, k: int, share: float | None) -> DataFrame | None:  # noqa: PLR0915
    """Search among vectors of one length; None if there is none. Equal vectors are one entry that remembers its k + 1
    smallest ids, since no others can be returned, so copies in any number neither crowd cells nor multiply work."""
    spark = rows.sparkSession
    half = max(1, dim // 2)
    few = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    entries = rows.withColumn("nth", few).filter(F.col("nth") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = materialize(entries.select(F.element_at("ids", 1).alias("gid"), "ids", "v"), "vectors")
    n = entries.count()
    if not n:
        return None
    sample = entries.orderBy(F.xxhash64("gid"), "gid").limit(SAMPLE_ROWS).select("v").toPandas()["v"]
    x = _unit(np.stack(sample.to_list()))
    size = int(min(MAX_CENTROIDS, len(x), max(1, n // PER_CENTROID)))
    c1 = kmeans(x[:, :half], size)
    c2 = kmeans(x[:, half:], size) if half < dim else np.zeros((1, 0))
    width, enough = len(c2), max(k + 1, int(np.ceil((enough_share(x, c1, c2, k) if share is None else share) * n)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _unit(np.stack(b.column(2).to_numpy(zero_copy_only=False)))
            cell = _distances(v[:, :half], c1).argmin(axis=1) * width + _distances(v[:, half:], c2).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], names=["gid", "ids", "v", "cell"])

    index = materialize(entries.mapInArrow(assign, "gid long, ids array<long>, v array<double>, cell int"), "index")
    held = np.zeros(len(c1) * width, np.int64)
    for r in index.groupBy("cell").count().collect():  # at most MAX_CENTROIDS squared rows
        held[r["cell"]] = r["count"]

    # neighbouring cells make blocks of about BLOCK_ROWS; a cell beyond that is dealt over several blocks of its own
    parts = np.maximum(1, -(-held // BLOCK_ROWS))
    base, block, room = np.zeros(len(held), np.int64), -1, 0
    for cell in np.flatnonzero(held):
        if parts[cell] > 1 or held[cell] > room:
            base[cell], block, room = block + 1, block + int(parts[cell]), BLOCK_ROWS if parts[cell] == 1 else 0
        base[cell] = base[cell] if parts[cell] > 1 else block
        room -= int(held[cell])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _unit(np.stack(b.column(1).to_numpy(zero_copy_only=False)))
            d1, d2 = _distances(v[:, :half], c1), _distances(v[:, half:], c2)
            at, blocks, cells = [], [], []
            for i in range(len(v)):
                mine = np.sort(np.array(walk(d1[i], d2[i], held, enough), np.int32))
                where = np.repeat(base[mine], parts[mine])
                mine = np.repeat(mine, parts[mine])
                where += np.arange(len(mine)) - np.searchsorted(mine, mine)  # each block of a dealt cell
                order = np.argsort(where, kind="stable")
                where, mine = where[order], mine[order]
                cut = np.flatnonzero(np.diff(where)) + 1
                blocks += where[np.append(0, cut)].tolist()
                cells += np.split(mine, cut)
                at += [i] * (len(cut) + 1)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(at, pa.int32())) for c in b.columns] + [pa.array(blocks, pa.int64()), pa.array(cells, pa.list_(pa.int32()))], names=["query_id", "v", "block", "cells"])

    spread = asked.repartition(2 * spark.sparkContext.defaultParallelism, "id")
    visits = materialize(spread.select(F.col("id").alias("query_id"), "v").mapInArrow(visit, "query_id long, v array<double>, block long, cells array<int>"), "visits")
    crowd = visits.groupBy("block").agg(F.ceil(F.count("*") / F.lit(BLOCK_QUERIES)).cast("int").alias("turns"))
    left = visits.join(crowd, "block").select("block", F.pmod(F.xxhash64("query_id"), "turns").cast("int").alias("turn"), "query_id", "v", "cells")
    homes = spark.createDataFrame([(int(c), int(base[c]), int(parts[c])) for c in np.flatnonzero(held)], "cell int, base long, parts int")
    placed = index.join(F.broadcast(homes), "cell").withColumn("block", F.col("base") + F.pmod(F.xxhash64("gid"), "parts"))  # bounded like cells
    right = placed.join(crowd, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "gid", "ids", "v", "cell")

    def rank(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(q) and len(e):
            e = e.sort_values(["cell", "gid"])
            own, gid, cell, ids = np.stack(e["v"].to_list()), e["gid"].to_numpy(), e["cell"].to_numpy(), e["ids"].to_list()
            ev = _unit(own)
            for qid, given, cells in zip(q["query_id"], q["v"], q["cells"], strict=True):
                v = _unit(given[None])[0]
                rows = np.flatnonzero(np.isin(cell, cells))
                s = ev[rows] @ v
                if len(rows) > k + 1:
                    rows = rows[s >= np.partition(s, -(k + 1))[-(k + 1)] - 1e-9]  # with all ties
                s = cosines(own[rows], given)
                for t in np.lexsort((gid[rows], -s))[: k + 1]:
                    out += [(qid, int(i), float(s[t])) for i in ids[rows[t]] if i != qid]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["block", "turn"]
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(rank, "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    discard(entries)
    return scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
