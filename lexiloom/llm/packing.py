"""Packing of tokenised documents into sequences of a fixed length.

The pieces' length histogram, of at most ``seq_len`` rows, is all that the plan needs. It comes from the configuration
linear program (fewest patterns that cover each length's count), solved by multiplicative weights: each length has a
price, a knapsack dynamic program finds the patterns of high total price, and prices of covered lengths sink. Weights
are rounded, and what is left, however much it is, goes by best-fit decreasing, counts at a time.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import materialize

SEQ_LEN = 2048
END_ID = 0
#: Words whose ids a worker remembers; about 100 bytes each.
REMEMBERED = 800_000
#: Rounds of multiplicative weights in each solution of the linear program.
ROUNDS = 20
#: What is added to weights before they are rounded down, solution by solution.
ROUNDINGS = (0.0, 0.5, 0.5, 0.999999)


class Words(dict):
    """Little-endian ids of text chunks that begin a pre-token, for one tokenizer.

    Byte-level pre-tokens never cross the gap before a blank unless that blank stands between other white space, so a
    text is the sum of its chunks, each kept with its leading blank. Other texts are encoded whole.
    """

    ODD = re.compile(r"\s (?:\s|\Z)|<\|")

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ranked = self._ranked(path, self.tokenizer.get_vocab())

    @staticmethod
    def _ranked(path: str, vocabulary: dict[str, int]):
        """A quicker encoder of single words, if the same vocabulary lies beside the file as ranks; ids are the same.

        Every rank is held against the tokenizer's own id; a file of another vocabulary is not used.
        """
        ranks = Path(path).with_suffix(".tiktoken")
        if not ranks.exists():
            return None
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.read_bytes().splitlines())}
        shown = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}  # byte-level names: others follow from 256 on
        shown |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        if any(vocabulary.get("".join(map(shown.__getitem__, token))) != rank for token, rank in merges.items()):
            return None
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # byte-level BPE's own
        return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=merges, special_tokens={}).encode_ordinary

    def words(self, new: list[str]) -> dict[str, bytes]:
        """Ids of each chunk: Latin ones by ranks, all others by the tokenizer."""
        latin = [w for w in new if max(w) < "\u0250"] if self.ranked else []
        out = {w: array("I", self.ranked(w)).tobytes() for w in latin}
        rest = [w for w in new if w not in out]
        for w, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False) if rest else [], strict=True):
            out[w] = np.array(e.ids, "<u4").tobytes()
        return out

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        chunked = [None if self.ODD.search(t) else t.replace(" ", "\0 ").split("\0") if "\0" not in t else None for t in texts]
        new = {w for ws in chunked if ws for w in ws if w not in self}
        new.discard("")
        extra = {}
        if new:
            new = sorted(new)
            extra = self.words(new)
            for w in new[: max(0, REMEMBERED - len(self))]:
                self[w] = extra.pop(w)
        extra[""] = b""
        get = self.get
        out = []
        for t, ws in zip(texts, chunked, strict=True):
            if ws is None:
                out.append(self.whole(t))
                continue
            ids = [get(w) for w in ws]
            out.append(b"".join(ids if None not in ids else [extra[w] if x is None else x for w, x in zip(ws, ids, strict=True)]))
        return out


_words: dict[str, Words] = {}


def _encoder(path: str) -> Words:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path not in _words:
        _words.clear()
        _words[path] = Words(path)
    return _words[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of each document: its ids, then ``end_id``, cut to at most ``seq_len``; only the first may be shorter.

    Columns: doc_id, piece, start, length, ids_crc32, and ``part``, ``nth`` (the task that cut it, and how many pieces
    of this length that task had before); with ``with_ids`` also ``ids array<int>``. A null text is an empty one and
    makes one piece of one id. Repeated rows give repeated pieces.
    """
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = _encoder(tokenizer_path), TaskContext.get().partitionId(), Counter()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                rows: list[tuple] = []
                for i, ids in enumerate(words.encode(b.column(1).to_pylist())):
                    ids += end
                    n, start, piece = len(ids) // 4, 0, 0
                    while start < n:
                        length = (n - start) % seq_len or seq_len
                        cut = ids[4 * start : 4 * (start + length)]
                        rows.append((i, piece, start, length, zlib.crc32(cut), seen[length], cut if with_ids else None))
                        seen[length] += 1
                        start, piece = start + length, piece + 1
                row, piece, start, length, crc, nth, cut = zip(*rows, strict=True)
                cols = [b.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()), pa.array(nth, pa.int64())]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in cut], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * with_ids)

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * with_ids)


def best_values(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack dynamic program: the highest total price of lengths within each room, and the last length taken there (index: length)."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(price > 0)
    cost = price[lengths]
    for room in range(1, capacity + 1):
        n = np.searchsorted(lengths, room, "right")
        best[room], took[room] = best[room - 1], 0
        if n:
            value = cost[:n] + best[room - lengths[:n]]
            k = int(value.argmax())
            if value[k] > best[room]:
                best[room], took[room] = value[k], lengths[k]
    return best, took


def _taken(took: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0:
        if took[room]:
            out.append(int(took[room]))
        room -= int(took[room]) or 1
    return out


def pattern_weights(counts: dict[int, int], capacity: int, rounds: int = ROUNDS, step: float = 0.2, short: float = 0.3) -> dict[tuple[int, ...], float]:
    """A fractional packing of ``counts`` into patterns, by multiplicative weights.

    Each round prices lengths by the tokens they hold and takes, for each length, the dearest pattern that holds it, if it
    costs at most the share ``short`` less than the dearest of all. It is taken as often as the round's part of its
    scarcest length, one ``step`` of the count, allows; then the prices of what is covered sink by exp(-share). Weights
    are scaled so that no length is covered beyond its count; what falls short is left to rounding.
    """
    lengths = np.array(sorted(counts))
    need = np.array([counts[x] for x in lengths], float)
    place = {int(x): i for i, x in enumerate(lengths)}
    covered, weight = np.zeros(len(lengths)), Counter()
    price = np.zeros(capacity + 1)
    for _ in range(rounds):
        log = -covered / need / step
        price[lengths] = lengths * np.exp(np.maximum(log - log.max(), -60))
        best, took = best_values(price, capacity)
        value, room = price[lengths] + best[capacity - lengths], step * need
        for i in np.flatnonzero(value >= (1 - short) * best[capacity])[::-1]:
            used = Counter([int(lengths[i]), *_taken(took, capacity - int(lengths[i]))])
            amount = min(room[place[x]] / k for x, k in used.items())
            if amount > 1e-9:
                for x, k in used.items():
                    room[place[x]] -= amount * k
                    covered[place[x]] += amount * k
                weight[tuple(sorted(used.elements(), reverse=True))] += amount
    most = float((covered / need).max(initial=0)) or 1.0
    return {p: w / most for p, w in weight.items()}


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing over a histogram: how many sequences of each pattern.

    Each length goes to the open sequences with the least room that takes it, as often as it fits. Sequences of one
    pattern are dealt together and each length splits at most one such group, so the work is bounded by lengths and
    capacity, whatever the counts are.
    """
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {capacity: []}
    size = np.zeros(capacity + 1, np.int64)

    def put(pattern: tuple[int, ...], room: int, n: int) -> None:
        groups.setdefault(room, []).append((pattern, n))
        size[room] += n

    for x in sorted((x for x, n in counts.items() if n), reverse=True):
        left = counts[x]
        while left:
            fits = np.flatnonzero(size[x:])
            if len(fits):
                room = x + int(fits[0])
                pattern, n = groups[room].pop()
                size[room] -= n
            else:
                room, pattern, n = capacity, (), -(-left // (capacity // x))
            k = room // x
            full = min(n, left // k)
            left -= full * k
            if full:
                put(pattern + (x,) * k, room - k * x, full)
            if full < n and left:  # fewer than k are left: one sequence takes them all
                put(pattern + (x,) * left, room - left * x, 1)
                full, left = full + 1, 0
            if full < n:
                put(pattern, room, n - full)
    out: Counter = Counter()
    for g in groups.values():
        for pattern, n in g:
            out[pattern] += n
    return out


def _rounded(left: Counter, weights: dict[tuple[int, ...], float], up: float) -> Counter:
    """Patterns as often as their weights plus ``up``, rounded down, say and ``left``, which shrinks, allows."""
    plan: Counter = Counter()
    for pattern, w in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        used = Counter(pattern)
        n = min(int(w + up), *(left[x] // k for x, k in used.items()))
        if n > 0:
            plan[pattern] += n
            left.subtract({x: n * k for x, k in used.items()})
    return plan


def plan_parts(counts: dict[int, int], capacity: int = SEQ_LEN, rounds: int = ROUNDS) -> tuple[Counter, Counter]:
    """Patterns of the rounded linear program, and best fit's for what rounding leaves.

    The program is solved anew for what each rounding leaves: weights are rounded down, then twice to the nearest, then
    up. Rounding up spends lengths that the rest may need, so of the roundings that took any pattern, as many count as
    leave the fewest sequences in all, more of them if that is equal.
    """
    left, kept = Counter({x: n for x, n in counts.items() if n}), Counter()
    found = []
    for up in ROUNDINGS:
        got = _rounded(left, pattern_weights(dict(left), capacity, rounds), up) if left else Counter()
        if got:
            kept, left = kept + got, Counter({x: n for x, n in left.items() if n})
            found.append((kept, best_fit(left, capacity)))
    return min(reversed(found), key=lambda f: sum(f[0].values()) + sum(f[1].values()), default=(kept, best_fit(left, capacity)))


def pack_plan(counts: dict[int, int], capacity: int = SEQ_LEN, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, how many sequences of it): each length occurs in all of them exactly as often as ``counts`` says.

    Pieces of a whole sequence stand alone; for all others see :func:`plan_parts`.
    """
    rest = Counter({x: n for x, n in counts.items() if n})
    whole = rest.pop(capacity, 0)
    solved, repaired = plan_parts(rest, capacity, rounds)
    plan = solved + repaired + Counter({(capacity,): whole} if whole else {})
    return sorted(plan.items(), key=lambda x: (-x[1], x[0]))


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """All pieces of ``docs`` with their places: sequence_id and offset, gapless from 0 in each sequence.

    The histogram (at most ``seq_len`` rows) is planned on the driver; pieces find their places by their rank among
    those of their length, which comes from counts per task and length, so no task ever sees all pieces of a length.
    The places broadcast are bounded by the plan: patterns, at most a few thousand, times lengths in them. An empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, tokenizer_path, seq_len, end_id, with_ids), "pieces")
    per_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, base, used = [], 0, Counter()
    for pattern, n in pack_plan(counts, seq_len):
        offset = 0
        for x, k in Counter(pattern).items():  # equal lengths stand side by side
            rows.append((x, used[x], used[x] + n * k, base, k, offset))
            used[x] += n * k
            offset += x * k
        base += n
    places = spark.createDataFrame(rows, "length long, lo long, hi long, base long, times int, at long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = per_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, ["length", "part"]).withColumn("rank", F.col("first") + F.col("nth"))
    on = (ranked["length"] == places["length"]) & (ranked["rank"] >= places["lo"]) & (ranked["rank"] < places["hi"])
    nth = F.col("rank") - F.col("lo")
    return ranked.join(F.broadcast(places), on).select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        (F.col("base") + F.floor(nth / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("at") + (nth % F.col("times")) * ranked["length"]).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
