"""Sharding by a k-d tree over document metadata.

Groups of equal texts are points with coordinates source, language, smallest doc_id and size. Values of a text coordinate
stand at the share of bytes before them, so whole values count. Nodes are split along their widest coordinate at a
weighted median, found by radix descent: each pass counts bytes in 4096 bins for every node of a level and goes on within
the bin that holds the median, with the text's hash as last digits. Groups too large for a shard are dealt over several
first; after the tree, large groups move from the fullest shards to the emptiest while that makes them more even.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import discard, materialize, skewed_lookup, text_or_empty

DIGIT, DIGITS = 12, 5  # 24 bits of a coordinate, then 36 bits of the text's hash
COORDINATES = ("source", "lang", "doc_id", "size")
#: A group of this share of a shard's target or more may move after the tree; there are at most WHOLE * n_shards of them.
WHOLE = 32
#: Levels after which points are written with their nodes.
WRITTEN = 6
EVEN = 0.005
SLOT_ROWS = 100_000


def _largest_first(pieces: list[tuple[int, object]], n: int) -> tuple[list[int], dict]:
    """Longest-processing-time placement: (load per shard, shard of each key)."""
    heap, load, at = [(0, s) for s in range(n)], [0] * n, {}
    for w, key in sorted(pieces, key=lambda x: (-x[0], str(x[1]))):
        _, s = heapq.heappop(heap)
        load[s] += w
        at[key] = s
        heapq.heappush(heap, (load[s], s))
    return load, at


def _evened(load: list[int], movable: list[tuple[int, int, str]]) -> dict[str, int]:
    """Moves (group: shard) of ``movable`` (shard, bytes, group) that even out ``load``, fullest shard to emptiest.

    Each takes the group nearest to half the difference, so the sum of squared loads sinks with every move. Shards within
    EVEN of the mean are even enough: where groups are small, the tree alone has made them so.
    """
    own, moved = defaultdict(list), {}
    for s, w, g in movable:
        bisect.insort(own[s], (w, g))
    load = list(load)
    for _ in range(4 * len(movable)):
        low = min(range(len(load)), key=lambda s: (load[s], s))
        best = None
        for s in sorted(range(len(load)), key=lambda s: (-load[s], s))[:4]:
            gap = load[s] - load[low]
            i = bisect.bisect_left(own[s], (gap / 2, ""))
            near = [own[s][k] for k in (i - 1, i) if 0 <= k < len(own[s]) and 0 < own[s][k][0] < gap]
            if near:
                best = s, min(near, key=lambda x: abs(x[0] - gap / 2))
                break
        if best is None or max(load) <= (1 + EVEN) * sum(load) / len(load):
            break
        s, (w, g) = best
        own[s].remove((w, g))
        bisect.insort(own[low], (w, g))
        load[s], load[low], moved[g] = load[s] - w, load[low] + w, low
    return moved


def _ranked(groups: DataFrame, name: str) -> DataFrame:
    """``(v, times, place)`` for each value of a text coordinate, null lowest: the share of bytes before it, and its groups.

    Values are sorted in ranges; bytes are summed per range, then within: no task sees all of them.
    """
    v = F.concat(F.when(F.col(name).isNull(), "0").otherwise("1"), F.coalesce(F.col(name).cast("string"), F.lit("")))
    each = groups.groupBy(v.alias("v")).agg(F.sum("w").alias("w"), F.count("*").alias("times"))
    each = materialize(each.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "values")
    total, ends = 0, []
    for r in each.groupBy("part").agg(F.sum("w").alias("w")).orderBy("part").collect():  # a row per partition
        ends.append((r["part"], total))
        total += r["w"]
    offsets = groups.sparkSession.createDataFrame(ends, "part int, base long")
    inner = F.coalesce(F.sum("w").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.withColumn("inner", inner).join(F.broadcast(offsets), "part").select("v", "times", ((F.col("base") + F.col("inner")) / F.lit(float(max(1, total)))).alias("place"))


def _points(groups: DataFrame, names: list[str], kinds: dict[str, str], n_groups: int) -> DataFrame:
    """``groups`` (g, w, n, the coordinates, h: 36 bits of hash) as points with ``ks``: a long per coordinate, 24 bits and the hash."""
    for i, c in enumerate(names):
        if kinds[c] == "string":
            keyed = groups.withColumn("v", F.concat(F.when(F.col(c).isNull(), "0").otherwise("1"), F.coalesce(F.col(c), F.lit(""))))
            groups = skewed_lookup(materialize(keyed, "keyed"), _ranked(groups, c), "v", "times", n_groups).drop("v").withColumnRenamed("place", f"c{i}")
        else:
            x = F.log2(F.col(c).cast("double")) if c == "size" else F.coalesce(F.col(c).cast("double"), F.lit(-1.0))
            groups = groups.withColumn(f"c{i}", x)
    groups = materialize(groups, "groups")
    ends = groups.agg(*[f(f"c{i}").alias(f"{k}{i}") for i in range(len(names)) for k, f in (("lo", F.min), ("hi", F.max))]).first()

    def scaled(i: int) -> Column:
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        if lo is None or hi <= lo:
            return F.lit(0).cast("long")
        return F.floor((F.col(f"c{i}") - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(2**24 - 1))).cast("long")

    ks = F.array(*[scaled(i) * F.lit(2**36) + F.col("h") for i in range(len(names))])
    return materialize(groups.select("g", "w", "n", ks.alias("ks"), F.lit(0).alias("node")), "points")


def kd_shards(docs: DataFrame, n_shards: int = 16, target_bytes: int | None = None) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)``: shards of near equal bytes, slots gapless from 0 in each.

    size is the text's UTF-8 bytes plus 1 (null text: none plus 1). Rows of equal text share a shard (null and empty
    count as equal) unless they alone exceed a shard's target: then rows are dealt by doc_id over as few shards as hold
    them. With ``target_bytes`` the number of shards is what reaches it; the driver holds WHOLE rows a shard at most.
    Columns source and lang may be missing or null, others may have any name. Repeated rows get slots of their own. An
    empty table gives an empty one.
    """
    spark = docs.sparkSession
    have = dict(docs.dtypes)
    text = text_or_empty()
    used = [c for c in ("source", "lang") if c in have]
    narrow = docs.select(
        "doc_id", *used, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("g")
    )
    rows = materialize(narrow, "sizes")
    total_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if target_bytes:
        n_shards = max(1, math.ceil(total / target_bytes))
    target = max(1, -(-total // n_shards))
    groups = rows.groupBy("g").agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.max("size").alias("size"), F.min("doc_id").alias("doc_id"), *[F.min(c).alias(c) for c in used])
    kinds = dict(groups.dtypes)
    names = [c for c in COORDINATES if c in kinds]
    groups = materialize(groups.withColumn("h", F.conv(F.substring("g", 1, 9), 16, 10).cast("long")), "groups")

    big = groups.filter(F.col("w") > target).select("g", "w", "n").collect()  # fewer than n_shards rows
    parts = {r["g"]: -(-r["w"] // target) for r in big}
    load, at = _largest_first([(r["w"] // parts[r["g"]], (r["g"], k)) for r in big for k in range(parts[r["g"]])], n_shards)
    room = [max(0, target - x) for x in load]
    points = _points(groups.filter(F.col("w") <= target), names, kinds, max(1, total_rows))
    written = points

    open_nodes, depth = [(0, n_shards)], 0
    while open_nodes := [x for x in open_nodes if x[1] - x[0] > 1]:
        ends = [(F.max(F.col("ks")[i]) - F.min(F.col("ks")[i])).alias(f"k{i}") for i in range(len(names))]
        wide = {r["node"]: r for r in points.groupBy("node").agg(F.sum("w").alias("w"), *ends).collect()}  # a row per node
        dim, want, low = {}, {}, {}
        for a, b in open_nodes:
            r, mid, whole = wide.get(a), (a + b) // 2, sum(room[a:b])
            dim[a] = max(range(len(names)), key=lambda i: (r[f"k{i}"] if r else 0, -i))
            want[a], low[a] = (r["w"] if r else 0) * (sum(room[a:mid]) / whole if whole else 0.5), 0
        going = {a for a, _ in open_nodes if a in wide}
        for step in range(DIGITS):
            if not going:
                break
            shift = DIGIT * (DIGITS - 1 - step)
            state = spark.createDataFrame([(a, dim[a], low[a], float(want[a])) for a in sorted(going)], "node int, dim int, low long, want double")
            bins = points.join(F.broadcast(state), "node").withColumn("bin", F.shiftright(F.expr("ks[dim]") - F.col("low"), shift)).filter(F.col("bin").between(0, 2**DIGIT - 1))
            bins = bins.groupBy("node", "bin").agg(F.sum("w").alias("w"), F.count("*").alias("n"), F.max("want").alias("want"))
            start = F.coalesce(F.sum("w").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            met = {r["node"]: r for r in bins.withColumn("start", start).filter("start <= want and want < start + w").collect()}
            for a in sorted(going):
                r = met.get(a)
                if r is None:  # all of the node is wanted on the left
                    low[a] += 2**DIGIT << shift
                    going.discard(a)
                    continue
                cut = r["bin"]
                want[a] -= r["start"]
                if r["n"] == 1 or r["w"] <= max(1, target // 4096) or step == DIGITS - 1:
                    going.discard(a)
                    cut += want[a] * 2 > r["w"]  # the nearer end of this bin
                low[a] += cut << shift
        cuts = spark.createDataFrame([(a, dim[a], low[a], (a + b) // 2) for a, b in open_nodes], "node int, dim int, low long, mid int")
        points = points.join(F.broadcast(cuts), "node", "left").withColumn("node", F.when(F.col("dim").isNull() | (F.expr("ks[dim]") < F.col("low")), F.col("node")).otherwise(F.col("mid"))).select("g", "w", "n", "ks", "node")
        open_nodes, depth = [half for a, b in open_nodes for half in ((a, (a + b) // 2), ((a + b) // 2, b))], depth + 1
        if depth % WRITTEN == 0:
            points = materialize(points, "points")
            discard(written)
            written = points

    if points is not written:
        points = materialize(points, "points")
        discard(written)
    for r in points.groupBy("node").agg(F.sum("w").alias("w")).collect():
        load[r["node"]] += r["w"]
    heavy = points.filter(F.col("w") >= max(2, target // WHOLE)).select("node", "w", "g").collect()
    moved = _evened(load, [(r["node"], r["w"], r["g"]) for r in heavy])
    small = points.select("g", "n", F.col("node").alias("shard"))
    if moved:
        to = spark.createDataFrame(list(moved.items()), "g string, other int")
        small = small.join(F.broadcast(to), "g", "left").select("g", "n", F.coalesce("other", "shard").alias("shard"))
    small = small.withColumn("shards", F.lit(None).cast("array<int>"))
    if big:
        dealt = spark.createDataFrame([(r["g"], r["n"], None, [at[r["g"], k] for k in range(parts[r["g"]])]) for r in big], "g string, n long, shard int, shards array<int>")
        small = small.unionByName(dealt)
    shard = F.coalesce("shard", F.element_at("shards", (F.pmod(F.xxhash64("doc_id", F.lit("part")), F.size("shards")) + 1).cast("int")))
    placed = skewed_lookup(rows.select("doc_id", "size", "text_crc32", "g"), small, "g", "n", total_rows).select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"))

    runs = max(8, -(-total_rows // (n_shards * SLOT_ROWS)))
    placed = materialize(placed.withColumn("run", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(runs)).cast("int")), "placed")
    discard(points, groups, rows)
    count = placed.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    first = count.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32"))
    return placed.withColumn("nth", nth).join(first, ["shard", "run"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"))
