"""Tables in folders: a keyed store of versions and deltas, and phases that go on where they stopped.

What Spark has written counts once its _SUCCESS file is there, the last thing that a job writes; whatever lacks it is as
if it were not. So nothing is renamed, readers never see a half, and any store that Spark writes to will do.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; a local master without one gets a temporary one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lexiloom-")
    return f"{base.rstrip('/')}/lexiloom/{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def is_written(spark: SparkSession, path: str) -> bool:
    store, p = _files(spark, f"{path}/_SUCCESS")
    return store.exists(p)


def written(spark: SparkSession, folder: str) -> list[str]:
    """Names of the finished tables in a folder, sorted; none if there is no folder."""
    store, p = _files(spark, folder)
    names = sorted(s.getPath().getName() for s in store.listStatus(p)) if store.exists(p) else []
    return [n for n in names if is_written(spark, f"{folder}/{n}")]


def drop(spark: SparkSession, path: str) -> None:
    store, p = _files(spark, path)
    store.delete(p, True)


class KeyedStore:
    """Rows by key in a folder, the last write of each: a snapshot, and deltas since.

    Each append is a table of its own. :meth:`compact` writes the next snapshot with the list of deltas that it holds; a
    delta that comes meanwhile is on no list and stays. Readers take the newest snapshot and the deltas that it does not
    hold. The ``keep`` newest snapshots and what their readers need stay; older ones go. Of rows with equal keys that
    with the highest ``order`` counts; ``deleted``, if true, removes the key.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: list[str], order: str = "written", deleted: str = "deleted", keep: int = 2) -> None:
        self.spark, self.folder, self.schema, self.keys, self.order, self.deleted, self.keep = spark, folder.rstrip("/"), schema, keys, order, deleted, keep

    def _names(self, kind: str) -> list[str]:
        return [n for n in written(self.spark, self.folder) if n.startswith(kind)]

    def _held(self, snapshot: str) -> set[str]:
        """Deltas that a snapshot holds: at most those appended between two clean-ups."""
        return {r["delta"] for r in self.spark.read.schema("delta string").parquet(f"{self.folder}/held-{snapshot[9:]}").collect()}

    def append(self, rows: DataFrame) -> str:
        name = f"delta-{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).write.parquet(f"{self.folder}/{name}")
        return name

    def _rows(self) -> tuple[DataFrame, list[str], str | None]:
        snapshots = self._names("snapshot-")
        last = snapshots[-1] if snapshots else None
        deltas = sorted(set(self._names("delta-")) - (self._held(last) if last else set()))
        paths = [f"{self.folder}/{n}" for n in ([last] if last else []) + deltas]
        read = self.spark.read.schema(self.schema)
        return (read.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)), deltas, last

    def _last(self, rows: DataFrame) -> DataFrame:
        newest = F.max_by(F.struct(*self.schema.names), F.struct(self.order, *[c for c in self.schema.names if c != self.order])).alias("r")
        return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)]).agg(newest).select("r.*").filter(~F.coalesce(F.col(self.deleted), F.lit(False)))

    def read(self, keep_if: Column | None = None) -> DataFrame:
        """The last write of each key that is not deleted; with ``keep_if`` those that have not expired."""
        rows = self._last(self._rows()[0])
        return rows if keep_if is None else rows.filter(keep_if)

    def compact(self, keep_if: Column | None = None) -> str:
        """Write the next snapshot, without what is deleted or, by ``keep_if``, expired, and drop what no reader needs."""
        rows, deltas, last = self._rows()
        nth = int(last[9:]) + 1 if last else 1
        held = sorted((self._held(last) & set(self._names("delta-")) if last else set()) | set(deltas))
        self.spark.createDataFrame([(n,) for n in held], "delta string").write.mode("overwrite").parquet(f"{self.folder}/held-{nth:08d}")
        now = self._last(rows)
        (now if keep_if is None else now.filter(keep_if)).write.parquet(f"{self.folder}/snapshot-{nth:08d}")
        snapshots = self._names("snapshot-")
        kept = snapshots[-self.keep :]
        for n in snapshots[: -self.keep]:
            drop(self.spark, f"{self.folder}/{n}")
            drop(self.spark, f"{self.folder}/held-{n[9:]}")
        if len(snapshots) >= self.keep:
            for n in self._held(kept[0]):
                drop(self.spark, f"{self.folder}/{n}")
        return f"snapshot-{nth:08d}"


class Phases:
    """Phases of a pipeline over documents, each written bucket by bucket, as UTF-8 JSON or Parquet.

    A bucket holds the documents of one share of the keys' hashes. A phase works on one bucket after another, each a job
    over its part of the phase before; buckets whose output is finished are passed over, so a run that was stopped goes
    on with the next bucket. Rows of a document must not depend on other buckets' documents.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id", buckets: int = 8, form: str = "json") -> None:
        self.spark, self.folder, self.key, self.buckets, self.form = spark, folder.rstrip("/"), key, buckets, form

    def _path(self, phase: str, bucket: int) -> str:
        return f"{self.folder}/{phase}/{bucket:05d}"

    def start(self, docs: DataFrame, phase: str = "input") -> str:
        """Deal the documents to their buckets, unless an earlier run did."""
        for b in range(self.buckets):
            if not is_written(self.spark, self._path(phase, b)):
                docs.filter(F.pmod(F.xxhash64(self.key), F.lit(self.buckets)) == b).write.mode("overwrite").parquet(self._path(phase, b))
        return phase

    def run(self, phase: str, work: Callable[[DataFrame], DataFrame], before: str = "input") -> list[int]:
        """``work`` on each bucket of phase ``before`` whose output is missing; gives the buckets that were worked on."""
        done = []
        for b in range(self.buckets):
            if is_written(self.spark, self._path(phase, b)):
                continue
            out = work(self._bucket(before, b))
            self._save_schema(phase, out.schema)
            out.write.mode("overwrite").format("parquet" if phase == "input" else self.form).save(self._path(phase, b))
            done.append(b)
        return done

    def _save_schema(self, phase: str, schema: StructType) -> None:
        path = f"{self.folder}/{phase}.schema"
        if not is_written(self.spark, path):
            self.spark.createDataFrame([(schema.json(),)], "schema string").write.mode("overwrite").json(path)

    def _schema(self, phase: str) -> StructType:
        import json

        return StructType.fromJson(json.loads(self.spark.read.schema("schema string").json(f"{self.folder}/{phase}.schema").first()["schema"]))

    def _bucket(self, phase: str, bucket: int) -> DataFrame:
        path = self._path(phase, bucket)
        return self.spark.read.parquet(path) if phase == "input" else self.spark.read.schema(self._schema(phase)).format(self.form).load(path)

    def read(self, phase: str) -> DataFrame:
        """All buckets of a phase; an error if one is missing."""
        missing = [b for b in range(self.buckets) if not is_written(self.spark, self._path(phase, b))]
        if missing:
            raise ValueError(f"phase {phase} lacks buckets {missing}")
        return reduce(DataFrame.unionByName, [self._bucket(phase, b) for b in range(self.buckets)])
