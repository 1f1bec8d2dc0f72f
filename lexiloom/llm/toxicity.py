"""Toxicity by compression distance.

Two Zstandard dictionaries are trained, one on windows of ordinary texts, one on windows of toxic texts; each has its
content and its entropy tables from its own windows alone. A window is a word between blanks, after a FRAME that both
kinds of windows begin with: a window that a dictionary knows is then one match, so lengths tell words apart that would
be too short for a block of their own. What toxic texts share with ordinary ones would drown the rest, so the toxic
dictionary is trained on windows that are typical of toxic texts. The differences of a text's compressed window lengths,
summed up in a few numbers, go through a threshold calibrated by cross-fitting: dictionaries of some training texts judge
the others.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.quality import held_out

#: At most so many labelled rows of each kind are fitted, chosen by a hash of their ids and texts, and of a text as many
#: characters as SAMPLE_CHARS, from a place that a hash of its id chooses.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_CHARS = 1500, 3000, 50_000
FRAME = bytes(range(128, 136))
#: Longer words are cut: all their pieces count.
WORD_BYTES = 64
LEVEL, FOLDS = 12, 4
#: Dictionary sizes, and the trainer's segment and key lengths.
ORDINARY_BYTES, TOXIC_BYTES, SEGMENT, KEY = 32_768, 2_048, 24, 8
#: Windows that train the ordinary dictionary, at most, chosen by a seeded shuffle.
ORDINARY_WINDOWS = 200_000
#: A word is typical of toxic texts from this z-score and log-odds on, and in so many texts and this share of them, over
#: passages that are counted once.
Z, LOG_ODDS, SUPPORT, SHARE = 2.0, 1.5, 3, 0.02
#: Words whose difference a worker remembers; beyond, it forgets all and goes on.
REMEMBERED = 400_000

_EDGES = re.compile(rb"^[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+$")


def _words(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII signs at their ends, in order; long ones in pieces; one empty word at least."""
    out = []
    for w in (text or "").lower().encode("utf-8", "surrogatepass").split():
        w = _EDGES.sub(b"", w)
        out += [w] if len(w) <= WORD_BYTES else [w[i : i + WORD_BYTES] for i in range(0, len(w), WORD_BYTES)]
    return out or [b""]


def _window(word: bytes) -> bytes:
    return FRAME + b" " + word + b" "


def passages(texts: list[str]) -> list[list[bytes]]:
    """Each text's words whose passage (the word, the one before and the one after) no earlier text has: copies count once."""
    out, seen = [], set()
    for t in texts:
        w = _words(t)
        keys = [hash(x) for x in zip([b"", *w[:-1]], w, [*w[1:], b""], strict=True)]
        out.append([x for x, k in zip(w, keys, strict=True) if x and k not in seen])
        seen.update(keys)
    return out


def _trained(windows: list[bytes], size: int) -> bytes:
    """A dictionary trained by Zstandard; too few windows for its trainer are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(size, windows, k=SEGMENT, d=KEY, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return (FRAME * 2 + b"".join(windows))[-size:]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """(ordinary, toxic), each trained on its own windows."""
    mine, theirs = passages(toxic), passages(ordinary)
    a, b = Counter(w for ws in mine for w in set(ws)), Counter(w for ws in theirs for w in set(ws))
    na, nb = len(toxic) + 1, len(ordinary) + 1

    def typical(w: bytes) -> bool:
        expected = b[w] * na / nb
        return a[w] >= max(SUPPORT, SHARE * na) and (a[w] - expected) / (a[w] + expected + 1) ** 0.5 > Z and np.log((a[w] + 0.5) / na) - np.log((b[w] + 0.5) / nb) > LOG_ODDS

    chosen = {w for w in a if typical(w)}
    plain = [w for ws in theirs for w in ws]
    if len(plain) > ORDINARY_WINDOWS:
        plain = [plain[i] for i in np.random.default_rng(17).permutation(len(plain))[:ORDINARY_WINDOWS]]
    return _trained([_window(w) for w in plain], ORDINARY_BYTES), _trained([_window(w) for ws in mine for w in ws if w in chosen], TOXIC_BYTES)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(content)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


class Distance:
    """Differences of compressed window lengths, ordinary less toxic, as numbers of a whole text."""

    NAMES = ("highest", "three_highest", "many_1", "many_4", "kinds_1", "kinds_3", "sum", "share", "log_windows")

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.toxic, self.known = _compressor(ordinary).compress, _compressor(toxic).compress, {}

    def of(self, word: bytes) -> int:
        w = _window(word)
        return len(self.plain(w)) - len(self.toxic(w))

    def __call__(self, text: str | None) -> list[float]:
        words, known = _words(text), self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.of(w)
        x = np.fromiter((known[w] for w in words), np.float64, len(words))
        top = np.sort(x[np.argpartition(x, -3)[-3:]] if len(x) > 3 else x)[::-1]
        kinds = [known[w] for w in set(words)]
        counts = int((x >= 1).sum()), int((x >= 4).sum()), sum(v >= 1 for v in kinds), sum(v >= 3 for v in kinds)
        return [top[0], top.mean(), *(min(n, 8) for n in counts), min(x[x > 0].sum(), 40), counts[0] / len(x), np.log(len(x))]


@dataclass(frozen=True)
class Detector:
    ordinary: bytes
    toxic: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float

    def scorer(self):
        distance, mean, scale, w = Distance(self.ordinary, self.toxic), np.array(self.mean), np.array(self.scale), np.array(self.weights)
        return lambda text: float(1 / (1 + np.exp(-np.clip((np.array(distance(text)) - mean) / scale @ w + self.bias, -500, 500))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(toxic: list[str], ordinary: list[str]) -> Detector:
    """A detector from texts of both kinds. Without either kind, every text scores the share of toxic ones."""
    n = len(Distance.NAMES)
    if not toxic or not ordinary:
        return Detector(FRAME, FRAME, (0.0,) * n, (1.0,) * n, (0.0,) * n, 500.0 if toxic else -500.0)
    rows, marks = [], []
    for k in range(FOLDS):
        rest = [[t for i, t in enumerate(x) if i % FOLDS != k] for x in (toxic, ordinary)]
        distance = Distance(*dictionaries(*rest))
        for texts, mark in ((toxic, 1), (ordinary, 0)):
            mine = texts[k::FOLDS]
            rows += [distance(t) for t in mine]
            marks += [mark] * len(mine)
    x, y = np.array(rows), np.array(marks, float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = _logistic((x - mean) / scale, y)
    return Detector(*dictionaries(toxic, ordinary), tuple(mean.tolist()), tuple(scale.tolist()), tuple(w[:-1].tolist()), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, ordinary: int = SAMPLE_ORDINARY) -> Detector:
    """A detector from ``labels`` (doc_id, toxic 0 or 1) of rows that are not held out, so many of each kind at most.

    Null labels teach nothing; an id labelled more than once counts with its highest label. The sampled ids, bounded in
    number, are broadcast to find their texts; of rows that share an id, those of a smaller hash count first, so that
    ``toxic`` and ``ordinary`` bound the rows too.
    """
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    pick = lambda df, is_toxic, n, *by: df.filter(F.col("toxic") == is_toxic).orderBy(*by).limit(n)
    first = F.xxhash64("doc_id"), "doc_id"
    sample = pick(marks, True, toxic, *first).unionByName(pick(marks, False, ordinary, *first))
    start = (F.pmod(F.xxhash64("doc_id", F.lit("start")), F.greatest(F.length("text") - F.lit(SAMPLE_CHARS), F.lit(1))) + 1).cast("int")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", F.substring("text", start, F.lit(SAMPLE_CHARS)).alias("text"))
    rows = F.xxhash64("doc_id", "text"), "doc_id", "text"
    got = pick(found, True, toxic, *rows).unionByName(pick(found, False, ordinary, *rows)).toPandas()
    got = got.sort_values(["doc_id", "text"], kind="stable")
    return train(list(got.text[got.toxic]), list(got.text[~got.toxic]))


def score(docs: DataFrame, detector: Detector) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of each row: score in [0, 1], higher for toxic; predicted if >= 0.7.

    All windows of whole texts count, however long; null texts score as empty ones; repeated rows score alike; an empty
    table gives an empty one. Other columns are not looked at.
    """
    src = docs.select("doc_id", held_out().alias("held_out"), "text")
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = detector.scorer()
        for b in batches:
            scores = pa.array([scorer(t.as_py()) for t in b.column(2)], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), scores], names=["doc_id", "held_out", "score"])

    return src.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
