"""Helpers that the operators of this subpackage share.

Conventions that hold for every operator here:

* Inputs are narrowed to the columns an operator needs before anything else, so extra columns, whatever their names,
  never clash with working columns.
* A null text counts as an empty one unless a docstring says otherwise; a null ``doc_id`` is a value of its own.
* Intermediate results that are read twice are written as Parquet under the folder named by ``spark.checkpoint.dir``,
  which all executors and the driver share; a lost executor then costs a reread, never a wrong result.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the ASCII control blanks.
BLANKS = r"\x20\x09-\x0D"
WORD = f"[^{BLANKS}]+"

#: A key is hot if it has at least one in HOT_SHARE of all rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 512


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates.

    Comes from ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary folder, kept for the
    session; on a cluster executors would not see one another's files there, so that is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lexiloom-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back: lineage ends here."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lexiloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexiloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_lexiloom_path", None)
        if path:
            spark = t.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-blank characters."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def unused_name(df: DataFrame, like: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    have = {c.lower() for c in df.columns}
    name = like
    while name.lower() in have:
        name += "_"
    return name


def skewed_lookup(rows: DataFrame, small: DataFrame, key: str, count: str, total: int, how: str = "left") -> DataFrame:
    """Join (``how``: left or inner) of ``rows`` to ``small``: one row per ``key``, its number of rows in ``count``.

    Keys with at least one in HOT_SHARE of all ``total`` rows, at most HOT_SHARE keys by counting, go through a
    broadcast; the others through a shuffled join. ``rows`` is read twice, so pass a materialised table.
    """
    least = max(1000, -(-total // HOT_SHARE))
    hot = F.broadcast(small.filter(F.col(count) >= least)).drop(count)
    cold = small.filter(F.col(count) < least).drop(count)
    marked = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return marked.unionByName(rest)
