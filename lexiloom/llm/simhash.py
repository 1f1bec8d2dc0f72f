"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Links join fingerprints that differ in at most ``radius`` bits. Covering masks (Pagh, "Locality-sensitive hashing
without false negatives") find all of them: each of the 64 bits gets a non-zero vector of GF(2)^(radius+1); mask v
keeps the bits whose vector is not orthogonal to v. The vectors of any ``radius`` bits span a proper subspace, so some
v != 0 is orthogonal to all of them: there the two fingerprints agree under the mask and meet in one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import discard, materialize, skewed_lookup, unused_name
from lexiloom.llm.components import connected_components

BITS = 64
#: A bucket of more fingerprints is dealt into sub-buckets by a further family of masks, which loses no pair either.
BUCKET = 4096
#: After so many families at most a few bits are unmasked, and distinct fingerprints that agree on the others are few.
LEVELS = 5


@cache
def covering_masks(radius: int = 3, level: int = 0) -> list[int]:
    """2^(radius+1) - 1 masks, as signed longs; ``level`` chooses another assignment of vectors to bits."""
    n = (1 << (radius + 1)) - 1
    vectors = [((i * (2 * level + 1) + (i // n) * level) % n) + 1 for i in range(BITS)]
    out = []
    for v in range(1, n + 1):
        m = sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def shingle_hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """The hash of each shingle of a whole text, in order; a text of fewer words than ``shingle`` is hashed whole."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks alone
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    k = min(shingle, len(words))
    return np.fromiter((digest(joined[i:j], seed) for i, j in zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)), np.uint64, len(words) - k + 1)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a whole text, unsigned; zero if it has no word."""
    return majority_bits(shingle_hashes(text, shingle, seed))


def majority_bits(h: np.ndarray) -> int:
    """The bits that over half of the hashes have; zero if there are none."""
    if not len(h):
        return 0
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` for each row of ``docs``; fp is the fingerprint as a signed long.

    Whole texts are read; a null, empty or blank text has fingerprint zero; a text of fewer words than ``shingle`` is
    hashed whole; repeated rows give repeated rows.
    """
    src = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, fp long")


def spanning_links(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(members, roots): for each group of ``points`` that links connect, all but its smallest, with the smallest.

    Exact, yet at most one row per point: a frontier walks through the points that are not reached yet.
    """
    left = np.sort(points)
    members, roots = [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            near = np.bitwise_count(left ^ front.pop()) <= radius
            if near.any():
                new, left = left[near], left[~near]
                members.append(new)
                roots.append(np.full(len(new), root, new.dtype))
                front.extend(new)
    if not members:
        none = np.zeros(0, points.dtype)
        return none, none
    return np.concatenate(members), np.concatenate(roots)


def links(distinct_fps: DataFrame, radius: int = 3) -> DataFrame:
    """``(a, b)``: links that connect just the fingerprints that chains of at most ``radius`` differing bits connect.

    ``distinct_fps`` has one row ``fp`` each. Buckets of one fingerprint go unseen into a count; the others are walked
    within one task each; a bucket over BUCKET is dealt again, exactly, by the next family of masks.
    """

    def dealt(rows: DataFrame, level: int) -> DataFrame:
        masks = covering_masks(radius, level)
        keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])
        by = ["bucket", "fp"] if "bucket" in rows.columns else ["fp"]
        x = rows.select(*by, F.explode(keys).alias("x"))
        own = F.xxhash64("bucket", "x.t", "x.k") if "bucket" in by else F.xxhash64("x.t", "x.k")
        return x.select(own.alias("bucket"), "fp")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for fps in b.column(0):
                members, roots = spanning_links(np.array(fps.as_py(), np.int64).view(np.uint64), radius)
                if len(members):
                    yield pa.RecordBatch.from_arrays([pa.array(members.view(np.int64)), pa.array(roots.view(np.int64))], names=["a", "b"])

    found, rows = None, distinct_fps
    for level in range(LEVELS):
        x = dealt(rows, level)
        size = x.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
        live = materialize(x.join(size, "bucket"), "buckets")
        last = level == LEVELS - 1
        small = live if last else live.filter(F.col("n") <= BUCKET)
        part = small.groupBy("bucket").agg(F.collect_set("fp").alias("fps")).select("fps").mapInArrow(walk, "a long, b long")
        found = part if found is None else found.unionByName(part)
        rows = live.filter(F.col("n") > BUCKET).select("bucket", "fp")
        if last or rows.isEmpty():
            break
    return found


def named_components(fps: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``fps``, whose ``classes`` (fp, low, n) links ``found`` connect."""
    total = fps.count()
    roots = connected_components(found)
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    small = named.select("fp", "root", "n").join(lowest, "root").select("fp", "n", "component_id")
    small = materialize(small, "components")
    return skewed_lookup(fps, small, "fp", "n", total).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp, component_id)``: the fingerprint of each row and the smallest doc_id that links reach from it.

    Copies collapse to one fingerprint before any search, so a group of copies of any size costs one row. Null texts
    count as empty ones, which link to one another; a null doc_id is never a component's name unless it has no other.
    An empty table gives an empty one.
    """
    fps = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "classes")
    out = named_components(fps, classes, links(classes.select("fp"), radius))
    discard(classes)
    return out


def keep_one(docs: DataFrame, find=near_duplicates, **options) -> DataFrame:  # noqa: ANN001
    """The rows of ``docs``, all columns, that stand for their group: one each.

    That is the row with the group's smallest doc_id; of rows that repeat this doc_id, one stays. A group whose
    doc_ids are all null keeps one row too. ``find`` finds the groups.
    """
    found = find(docs, **options)
    rows, name = unused_name(docs, "rows"), unused_name(docs, "kept_id")
    keep = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias(name)).agg(F.count("*").alias(rows))
    keep = materialize(keep, "kept")
    out = docs.join(keep, F.col("doc_id").eqNullSafe(F.col(name)))
    if keep.filter(F.col(rows) > 1).isEmpty():
        return out.select(*[F.col(f"`{c}`") for c in docs.columns])
    once = out.filter(F.col(rows) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
    more = out.filter(F.col(rows) > 1).select(*[F.col(f"`{c}`") for c in docs.columns]).dropDuplicates(["doc_id"])
    return once.unionByName(more)
