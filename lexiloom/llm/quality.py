"""Quality scores by Bradley-Terry pairwise ranking.

Documents are compared, not classified: over preference pairs (a document marked good, one marked bad) the logistic loss
on differences of features makes P(good beats bad) = sigmoid(score difference) likely. The threshold is the quantile of
the training scores at the share of bad ones; a document's score is sigmoid(its score - threshold).

Features are DataFrame expressions over whole texts, so scoring is one pass without Python or a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import text_or_empty, word_count

#: At most so many labelled rows are fitted, chosen by a hash of their ids, and so many preference pairs of them.
SAMPLE_ROWS = 20_000
SAMPLE_PAIRS = 200_000


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows from which no label is learnt: crc32 of the id as text is 1 modulo 3. Null ids count as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


#: name -> a count over the text; each becomes log(1 + 100 * count / units).
COUNTS = {
    "capitals": (r"\p{Lu}", "chars"),
    "digits": (r"\p{Nd}", "chars"),
    "symbols": (r"[#$%&*|^~=<>@+_/\\\[\]{}]", "words"),
    "bangs": (r"[!?]", "words"),
    "bars": (r"\|", "words"),
    "twice": (r"(?<![^\s])([^\s]{1,60}) \1(?![^\s])", "words"),
    "odd": r"[^\p{L}\p{N}\p{P}\p{S}\s]",
    "ends": r"[.!?](?=\s|$)",
}


def bound(text: Column, body) -> Column:  # noqa: ANN001
    """``body(lengths)`` with (chars, words) of the text counted once, however often the body reads them, also in filters."""
    lengths = F.struct(F.greatest(F.length(text), F.lit(1)).alias("chars"), word_count(text).alias("words"))
    return F.element_at(F.transform(F.array(lengths), body), 1)


def features(text: Column, lengths: Column) -> list[tuple[str, Column]]:
    """Named numbers of a text whose ``lengths`` are bound, all finite; of an empty text, zero."""
    chars, words = lengths["chars"], F.greatest(lengths["words"], F.lit(1))
    out = []
    for name, what in COUNTS.items():
        pattern, unit = what if isinstance(what, tuple) else (what, "words")
        out.append((name, F.log1p(100.0 * F.regexp_count(text, F.lit(pattern)) / (chars if unit == "chars" else words))))
    out.append(("word_length", F.log1p(F.length(text) / words)))
    out.append(("words", F.log1p(lengths["words"].cast("double"))))
    out.append(("distinct", F.log1p(F.size(F.array_distinct(F.split(text, r"\s+"))).cast("double")) - F.log1p(words.cast("double"))))
    return out


def feature_array(text: Column) -> Column:
    return bound(text, lambda x: F.array(*[f for _, f in features(text, x)]))


@dataclass(frozen=True)
class Ranker:
    weights: tuple[float, ...]
    threshold: float

    def raw(self, text: Column) -> Column:
        def total(lengths: Column) -> Column:
            parts = [F.lit(w) * f for w, (_, f) in zip(self.weights, features(text, lengths), strict=True)]
            return reduce(lambda a, b: a + b, parts)

        return bound(text, total)

    def score(self, text: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(F.greatest(F.lit(self.threshold) - self.raw(text), F.lit(-500.0)), F.lit(500.0))))


def bradley_terry(x: np.ndarray, good: np.ndarray, pairs: int = SAMPLE_PAIRS, seed: int = 11, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """(weights, threshold) from features of rows marked good or not, by Newton's method on sampled pairs.

    Without both marks nothing can be preferred: weights are zero.
    """
    hi, lo = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(hi) or not len(lo):
        return np.zeros(x.shape[1]), 0.0
    scale = x.std(axis=0)
    scale[scale < 1e-9] = np.inf
    z, rng = x / scale, np.random.default_rng(seed)
    d = z[rng.choice(hi, pairs)] - z[rng.choice(lo, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -500, 500)))
        grad = d.T @ (p - 1) / pairs + ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = np.sort(z @ w)
    n = len(lo)  # the quantile at the share of bad rows, halfway to its neighbour
    return w / scale, float((s[n - 1] + s[n]) / 2)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Ranker:
    """A ranker from ``labels`` (doc_id, quality 0 or 1) of rows that are not held out, ``rows`` of them at most.

    Null labels teach nothing; an id labelled more than once counts with its highest label. ``docs`` is read whole for
    the sampled ids alone, which are broadcast: their number is bounded.
    """
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = text_or_empty()
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", feature_array(text).alias("x"))
    got = found.orderBy(F.xxhash64("doc_id", "x"), "doc_id", "x").limit(rows).select("quality", "x").toPandas()  # ids may repeat
    marked = sorted([float(q), *map(float, x)] for q, x in zip(got["quality"], got["x"], strict=True))
    got = np.array(marked) if marked else np.zeros((0, 1 + len(COUNTS) + 3))
    w, threshold = bradley_terry(got[:, 1:], got[:, 0] > 0)
    return Ranker(tuple(float(v) for v in w), threshold)


def score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of each row: score in [0, 1], higher for better; predicted if >= 0.5.

    Null texts score as empty ones. Repeated rows score alike. An empty table gives an empty one.
    """
    s = ranker.score(text_or_empty())
    return docs.select("doc_id", held_out().alias("held_out"), s.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """The rows of ``docs``, all columns, that the ranker predicts good."""
    return docs.filter(ranker.score(text_or_empty()) >= 0.5)
