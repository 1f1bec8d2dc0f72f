"""Connected components of a graph of long ids, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import discard, materialize


def _star_mark(edges: DataFrame) -> tuple[int, int, int]:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(2**31)), F.sum(F.xxhash64("v", "u") % F.lit(2**31))).first()
    return tuple(x or 0 for x in r)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows ``(node, root)`` for each node that has a link to another; root is the component's smallest node.

    Alternating large-star and small-star steps: each rewires links towards local minima, keeps components, and never
    makes more links than there are. They end, after about the square of the logarithm of the size, in stars. Minima are
    aggregated before joining, so a node of any degree is fine: its links are dealt over tasks by skew-join splitting.
    Nulls and self-links are dropped (no link). An empty table gives an empty one.
    """
    pair = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = materialize(pair, "links")
    mark = _star_mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v")).distinct()
        after = materialize(small, "links")
        discard(e)
        e, was, mark = after, mark, _star_mark(after)
        if mark == was:
            break
    member = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return member.unionByName(member.select(F.col("root").alias("node"), "root").distinct())
