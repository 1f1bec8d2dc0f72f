"""Translation engines by name, translation through a cache, and term search over providers in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.operators.crossdoc import canonical_params

CACHE = "engine string, params string, text string, translation string, written timestamp"
NAME_LIMIT = 20  # fixed value: names of engines are shorter


@dataclass(frozen=True)
class Engine:
    """A function from text to text under a name; ``params`` change its results and are part of the cache's key."""

    name: str
    translate: Callable[[str], str]
    params: dict = field(default_factory=dict)
    is_available: Callable[[], bool] = lambda: True

    def __post_init__(self) -> None:
        if len(self.name) >= NAME_LIMIT:
            raise ValueError(f"an engine's name has fewer than {NAME_LIMIT} characters: {self.name}")

    def having(self, **params: object) -> Engine:
        """The same engine with further parameters: what was cached without them does not count."""
        return Engine(self.name, self.translate, {**self.params, **params}, self.is_available)


class Engines:
    """Engines by name, one of them in use. Calls come from the driver; a plan keeps the engine it was built with."""

    def __init__(self, default: str) -> None:
        self.default, self.engines = default, {}
        self.active: str | None = None

    def register(self, engine: Engine) -> None:
        self.engines[engine.name] = engine

    def get(self, name: str | None = None) -> Engine:
        """By name, else the one in use, else the default; KeyError if it is not registered."""
        return self.engines[name or self.active or self.default]

    def switch(self, name: str) -> None:
        if not self.engines[name].is_available():
            raise RuntimeError(f"engine {name} is not available")
        self.active = name

    def available(self) -> list[str]:
        return [e.name for e in self.engines.values() if e.is_available()]


def translate_through(texts: DataFrame, cache: DataFrame, engine: Engine, ignore_cache: bool = False) -> DataFrame:
    """``(text, translation, cached)`` of distinct texts: from the engine's rows of the cache, else from the engine.

    The cache's last row of a text counts. With ``ignore_cache`` every text is translated anew. Null texts are left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"text": f["text"], "translation": f["text"].map(engine.translate), "cached": False})

    asked = texts.select("text").filter("text is not null").distinct()
    schema = "text string, translation string, cached boolean"
    if ignore_cache:
        return asked.mapInPandas(run, schema)
    mine = cache.filter((F.col("engine") == engine.name) & (F.col("params") == canonical_params(engine.params)))
    known = mine.groupBy("text").agg(F.max_by("translation", "written").alias("translation"))
    found = asked.join(known, "text").select("text", "translation", F.lit(True).alias("cached"))
    return found.unionByName(asked.join(known, "text", "left_anti").mapInPandas(run, schema))


def cache_rows(translated: DataFrame, engine: Engine, keep_unchanged: bool = True) -> DataFrame:
    """New rows for the cache. Single translations are kept as they come; batches keep neither empty nor unchanged ones."""
    new = translated.filter("not cached")
    new = new if keep_unchanged else new.filter("translation <> '' and translation <> text")
    return new.select(F.lit(engine.name).alias("engine"), F.lit(canonical_params(engine.params)).alias("params"), "text", "translation", F.current_timestamp().alias("written"))


def save_cache(rows: DataFrame, path: str) -> None:
    """Rows are added, never rewritten, so a lost or repeated task leaves the cache whole; readers take the last per key."""
    rows.write.mode("append").partitionBy("engine").parquet(path)


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache under ``path``, empty if there is none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path)


def search_terms(terms: DataFrame, answers: DataFrame, offline: bool = False) -> DataFrame:
    """``(term, candidate, source_type, confidence)``: of each distinct term the answer of the first provider that has one.

    ``answers``: term, priority, candidate, source_type, confidence. Without an answer the type is "none", offline
    "manual"; both have an empty candidate and low confidence. Equal priorities: the least source_type, then candidate.
    """
    asked = terms.select("term").filter("term is not null").distinct()
    nothing = {"candidate": F.lit(""), "source_type": F.lit("manual" if offline else "none"), "confidence": F.lit("low")}
    if offline:
        return asked.withColumns(nothing)
    first = Window.partitionBy("term").orderBy("priority", "source_type", "candidate")
    best = answers.filter("candidate <> ''").withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    d = asked.join(best, "term", "left")
    return d.select("term", *[F.coalesce(F.col(c), otherwise).alias(c) for c, otherwise in nothing.items()])
