"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing cuts a sequence of symbols into short phrases by looking at a few neighbours alone; phrases
get names from their symbols and are parsed again. Equal substrings so get equal phrases, at every level, but for a few
at their ends, wherever they stand. A fingerprint keeps, for each of 64 bins, the least hash among the names of phrases
of the second level and above; likeness is the share of bins that agree, an estimate of the Jaccard index of names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS, HEX, EMPTY = 64, 4, 0xFFFF
ROUNDS = 4  # of coin tossing: 64-bit names, then labels under 128, 14, 8 and 6
#: Characters that are parsed at a time, as one array; a longer text goes alone.
BATCH_CHARS = 400_000
#: Rows that are looked at for each bucket's end.
PER_PART = 100

U = np.uint64
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)], U)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(29))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


def _phrases(x: np.ndarray, seg: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """One level: names and segments of the phrases of symbols ``x``; phrases never cross segments."""
    # a run of one symbol becomes one symbol, so that neighbours differ
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (seg[1:] != seg[:-1])
    at = np.flatnonzero(new)
    long = np.diff(np.append(at, len(x)))
    x, seg = x[at], seg[at]
    x = np.where(long > 1, _mix(x + long.astype(U) * U(0x9E3779B97F4A7C15)), x)
    first = np.ones(len(x), bool)
    first[1:] = seg[1:] != seg[:-1]
    # coin tossing: the lowest bit in which a symbol differs from the one before, and its value
    lab = x
    for _ in range(ROUNDS):
        before = np.empty_like(lab)
        before[1:] = lab[:-1]
        before[first] = ~lab[first]
        diff = lab ^ before
        low = diff & (~diff + U(1))
        k = np.bitwise_count(low - U(1)).astype(U)
        lab = (k << U(1)) | ((lab & low) != 0).astype(U)
    cut = first.copy()
    cut[1:-1] |= (lab[1:-1] > lab[:-2]) & (lab[1:-1] > lab[2:]) & ~first[1:-1] & ~first[2:]
    at = np.flatnonzero(cut)
    place = np.arange(len(x)) - np.repeat(at, np.diff(np.append(at, len(x))))
    names = _mix(np.add.reduceat(x * _POWERS[np.minimum(place, 63)], at) + U(level))
    return names, seg[at]


def fingerprints(texts: list[str]) -> np.ndarray:
    """(texts, BINS) of uint16: the sketch of each text; a bin without a name is EMPTY, so an empty text has no other."""
    out = np.full((len(texts), BINS), EMPTY, np.uint16)
    coded = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    lengths = np.array([len(c) for c in coded])
    if not lengths.sum():
        return out
    x, seg = _mix(np.concatenate(coded).astype(U) + U(1)), np.repeat(np.arange(len(texts)), lengths)
    names, owners, level = [], [], 0
    while len(x):
        level += 1
        x, seg = _phrases(x, seg, level)
        if level >= 2:
            names.append(x)
            owners.append(seg)
            more = np.bincount(seg, minlength=len(texts))[seg] > 1  # a text ends with its one phrase, whatever the others
            x, seg = x[more], seg[more]
    x, seg = np.concatenate(names), np.concatenate(owners)
    key = seg * BINS + (x & U(BINS - 1)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, value = key[order], (x >> U(6))[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    least = np.minimum.reduceat(value, at)
    out.reshape(-1)[key[at]] = (_mix(least) % U(EMPTY)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of bins that agree, of those that either row fills; two empty texts are alike."""
    either = ((a != EMPTY) | (b != EMPTY)).sum(axis=-1)
    same = ((a == b) & (a != EMPTY)).sum(axis=-1)
    return np.where(either == 0, 1.0, same / np.maximum(either, 1))


def as_hex(sketch: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in sketch.astype(">u2")]


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _before(bounds: list[tuple], lo: int, hi: int) -> Column:
    """The bucket of a row, a number from ``lo`` to ``hi``: how many of ``bounds`` (doc_id, mark) are not above it."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    i, mark = bounds[mid]
    same = F.col("doc_id").isNull() & (F.col("mark") < mark) if i is None else F.col("doc_id").isNull() | (F.col("doc_id") < F.lit(i)) | ((F.col("doc_id") == F.lit(i)) & (F.col("mark") < mark))
    return F.when(same, _before(bounds, lo, mid)).otherwise(_before(bounds, mid + 1, hi))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """``(bucket, head, doc_id, mark, text)``: rows dealt into ``parts`` buckets of consecutive ids; head rows end a bucket.

    A head is the first row after the bucket (after the last bucket: of all), so each bucket knows the row that follows
    each of its own. Buckets end at quantiles of a sample of some PER_PART rows a bucket, chosen by a hash of id and text, so ids may be of any type and spread. Null ids come first; rows of equal id are ordered by ``mark``, a hash of
    their text, and may lie in several buckets.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    share = min(1.0, PER_PART * parts / max(1, docs.count()))
    chosen = rows.select("doc_id", "mark").filter(F.pmod(F.xxhash64("doc_id", "mark"), F.lit(2**31)) < F.lit(int(share * 2**31))).distinct().collect()
    chosen = sorted({(r["doc_id"], r["mark"]) for r in chosen}, key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, x[1]))
    bounds = sorted({chosen[len(chosen) * i // parts] for i in range(1, parts)} if chosen else set(), key=chosen.index)
    dealt = rows.withColumn("bucket", _before(bounds, 0, len(bounds)).cast("int"))
    first = {r["bucket"]: (r["low"]["doc_id"], r["low"]["mark"]) for r in dealt.groupBy("bucket").agg(F.min(F.struct("doc_id", "mark")).alias("low")).collect()}
    order = sorted(first)
    ends = [(*first[b], order[i - 1] if i else order[-1]) for i, b in enumerate(order)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    low = spark.createDataFrame(ends, f"low {kind}, low_mark long, bucket int")
    heads = rows.join(F.broadcast(low), F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("mark") == F.col("low_mark")))
    heads = heads.groupBy("bucket", "doc_id", "mark").agg(F.min("text").alias("text"))
    cols = ["bucket", "head", "doc_id", "mark", "text"]
    both = dealt.withColumn("head", F.lit(False)).select(*cols).unionByName(heads.withColumn("head", F.lit(True)).select(*cols))
    return both.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "head", "doc_id", "mark", "text")


def fingerprint_documents(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of whole texts and of their edited texts, and how alike they are.

    Columns: doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The
    next document is that of the next doc_id; after the last comes the first, which for a single row is itself. Null
    texts are empty; repeated rows follow one another, and of equal ids the text of the smaller hash comes first. An empty
    table gives an empty one; other columns are not looked at. A very long text is parsed alone, in memory some hundred
    times its length. One shuffle of the texts.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def flush(todo: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        ids, texts, nexts = zip(*todo, strict=True)
        changed = [edited(t, n) for t, n in zip(texts, nexts, strict=True)]
        own, new = fingerprints([*texts, nexts[-1]]), fingerprints(changed)
        following = own[1:]  # todo is consecutive: each next text is the one after
        own = own[:-1]
        sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, id_type), pa.array([len(t) for t in texts], pa.int64()), pa.array(sha), pa.array(as_hex(own)), pa.array(as_hex(new)), pa.array(likeness(own, new), pa.float64()), pa.array(likeness(own, following), pa.float64())],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, todo, chars = None, [], 0
        for b in batches:
            heads, ids, texts = (b.column(i).to_pylist() for i in (1, 2, 4))
            for head, i, text in zip(heads, ids, texts, strict=True):
                if last is not None:
                    todo.append((*last, text))
                    chars += len(last[1])
                last = None if head else (i, text)
                if todo and (chars > BATCH_CHARS or head):
                    yield flush(todo, b.column(2).type)
                    todo, chars = [], 0

    return with_next(docs, parts).mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
