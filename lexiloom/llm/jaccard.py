"""Near-duplicates by SimHash and the exact Jaccard similarity of word shingles.

Documents of one shingle set are one class, with a SimHash fingerprint of that set. Classes whose fingerprints differ in
few bits meet in the buckets of covering masks, as in :mod:`simhash`, without exception. Similar sets can differ in more
bits, so classes meet in buckets of MinHash bands besides: a pair of similarity s shares no band with probability
(1 - s^ROWS)^BANDS: 3 in 100,000 at 0.8, less above. Within a bucket shingle sets themselves are compared, so every link
is a pair of at least the asked similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import discard, materialize
from lexiloom.llm.simhash import covering_masks, majority_bits, named_components, shingle_hashes

BANDS, ROWS = 20, 4
#: Bits that two fingerprints may differ in to meet for certain.
RADIUS = 3
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The hashes of a whole text's distinct shingles, ascending; none if it has no word."""
    return np.unique(shingle_hashes(text, shingle, seed))


def band_keys(s: np.ndarray) -> list[int]:
    """One signed long per band, of ROWS minima each; none for an empty set."""
    if not len(s):
        return []
    low = np.array([(s * f).min() for f in _FACTORS], "<u8").reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(low)]


def simhash_keys(s: np.ndarray, radius: int = RADIUS) -> list[int]:
    """One signed long per covering mask: sets whose fingerprints differ in at most ``radius`` bits share one; none for an empty set."""
    if not len(s):
        return []
    fp = majority_bits(s)
    return [xxhash.xxh64_intdigest((fp & m % (1 << 64)).to_bytes(8, "little"), BANDS + i) - (1 << 63) for i, m in enumerate(covering_masks(radius))]


def _class_of(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) if len(s) else 0


def similar_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Places of sets that links of at least ``similarity`` connect, each but the group's first with that one.

    A frontier walks through the sets that are not reached yet, so a group of copies costs one comparison each.
    """
    size = np.array([len(s) for s in sets])
    left, out = np.arange(len(sets)), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            a = sets[front.pop()]
            at = left[np.minimum(size[left], len(a)) >= similarity * np.maximum(size[left], len(a))]
            if not len(at):
                continue
            all_of = np.concatenate([sets[i] for i in at])
            same = a[np.minimum(np.searchsorted(a, all_of), len(a) - 1)] == all_of
            common = np.add.reduceat(same, np.concatenate([[0], np.cumsum(size[at])[:-1]]), dtype=np.int64)
            near = at[common >= similarity * (size[at] + len(a) - common)]
            out += [(int(i), int(root)) for i in near]
            front.extend(near)
            left = np.setdiff1d(left, near, assume_unique=True)
    return out


def links(classes: DataFrame, docs: DataFrame, similarity: float, shingle: int, seed: int) -> DataFrame:
    """``(a, b)``: links that connect the classes that chains of at least ``similarity`` connect.

    ``classes`` has fp and keys. Buckets of the same classes, as the bands of one pair make them, are compared once;
    only classes that share a bucket have their shingle sets made and shuffled.
    """
    shared = classes.select("fp", F.explode("keys").alias("k"))
    bucket = shared.groupBy("k").agg(F.sort_array(F.collect_set("fp")).alias("fps")).filter("size(fps) > 1").select("fps").distinct()
    bucket = materialize(bucket.select(F.xxhash64("fps").alias("g"), F.explode("fps").alias("fp")), "buckets")
    live = materialize(bucket.select("fp").distinct(), "live")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                sets = [shingle_set(t.as_py(), shingle, seed) for t in whole.column(0).slice(at, 512)]
                yield pa.RecordBatch.from_arrays([pa.array([_class_of(s) for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["fp", "s"])

    def walk(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("fp")
        ids = group.column("fp").to_pylist()
        found = similar_links([np.frombuffer(s.as_py(), "<u8") for s in group.column("s")], similarity)
        return pa.table({"a": pa.array([ids[i] for i, _ in found], pa.int64()), "b": pa.array([ids[j] for _, j in found], pa.int64())})

    sets = docs.select("text").mapInArrow(run, "fp long, s binary").join(live, "fp", "left_semi").groupBy("fp").agg(F.first("s").alias("s"))
    return bucket.join(sets, "fp").groupBy("g").applyInArrow(walk, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, seed: int = 42) -> DataFrame:
    """``(doc_id, fp, component_id)``: the class of each row and the smallest doc_id that links reach from it.

    Whole texts count. Texts without a word are one class; a text of fewer words than ``shingle`` is one shingle.
    Nulls, repeated rows and empty tables are as in :func:`simhash.near_duplicates`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = (shingle_set(t.as_py(), shingle, seed) for t in b.column(1))
            fp, keys = zip(*((_class_of(s), simhash_keys(s) + band_keys(s)) for s in sets), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "fp", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = materialize(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long, keys array<long>"), "bands")
    classes = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"), F.first("keys").alias("keys")), "classes")
    out = named_components(made.select("doc_id", "fp"), classes.select("fp", "low", "n"), links(classes, docs, similarity, shingle, seed))
    discard(classes)
    return out
