"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every document has a place in its source: a seeded hash. Equal stretches of places are the source's BLOCKS blocks, and a
seeded permutation orders them. A mix takes all blocks of a source as often as its target allows and, once more, the
first blocks of the permutation; the last of these is narrowed digit by digit until it holds few documents, which are
chosen one by one to meet the target. So each source has an exact quota of drawn blocks. The tree shares the quotas among
output shards: those of a range of shards are split between its halves by a multivariate-hypergeometric draw. The drawn
blocks, permuted again, go to the shards as their quotas say, each to one, and each shard is ordered by hash.

DataFrame operations only; the driver holds a few rows per source.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import BLANKS, materialize, skewed_lookup, text_or_empty, unused_name, word_count

BITS, DIGIT = 56, 8
BLOCKS = 1 << DIGIT
#: A last block of so many documents is settled one by one.
FEW = 256
#: Per-source rows, of some 2 KB, are broadcast up to this number of sources; beyond, only those of hot sources are.
BROADCAST_SOURCES = 1000
#: Copies of one row that are numbered at a time.
COPIES = 10_000


def source_targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, total: int | None = None) -> dict[str | None, float]:
    """Targets by weight, in code point order with null last, none above ``most`` times its source.

    What exceeds that is shared again, by weight, among the sources below it, until none is above. By default the
    targets share the total of all sizes.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_ones, out = float(sum(sizes.values()) if total is None else total), list(order), {}
    while open_ones:
        whole = sum(weight[s] for s in open_ones)
        share = {s: left * weight[s] / whole for s in open_ones}
        over = [s for s in open_ones if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ones = [s for s in open_ones if s not in out]
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources): exact quotas split by the tree; rows differ by at most one in their sums at each split."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(q: np.ndarray, a: int, b: int) -> None:
        if b - a == 1:
            out[a] = q
            return
        mid = (a + b) // 2
        left = rng.multivariate_hypergeometric(q, round(int(q.sum()) * (mid - a) / (b - a)), method="marginals")
        split(left, a, mid)
        split(q - left, mid, b)

    split(np.asarray(quotas, np.int64), 0, shards)
    return out


def _unit() -> Column:
    """Rows that agree in source, doc_id and text are copies of one unit: 128 bits name it."""
    parts = [x for c in ("source", "doc_id", "text") for x in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


def _spot(seed: int, unit: str, copy: str) -> Column:
    """A copy's place in its source, of BITS bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), f"{unit}.a", f"{unit}.b", copy), 64 - BITS)


def _with_sources(rows: DataFrame, per_source: DataFrame, into: str, n: int) -> DataFrame:
    """``rows`` of the sources in ``per_source`` (source, rows, and more, of ``n`` sources) with its row as struct ``into``."""
    source = unused_name(rows, "of")
    small = per_source.select(F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit(""))).alias(source), F.struct(*[c for c in per_source.columns if c != "rows"]).alias(into), "rows")
    keyed = rows.withColumn(source, F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce(F.col("source"), F.lit(""))))
    if n <= BROADCAST_SOURCES:
        return keyed.join(F.broadcast(small.drop("rows")), source).drop(source)
    count = unused_name(rows, "rows")
    total = per_source.agg(F.sum("rows")).first()[0]
    return skewed_lookup(keyed, small.withColumnRenamed("rows", count), source, count, total, how="inner").drop(source)


def _numbered(rows: DataFrame, unit: str, copy: str, again: DataFrame | None) -> DataFrame:
    """``rows`` with their number among the copies of their unit; ``again`` has the units of several copies.

    Copies are numbered where they lie, and then over the tasks that hold some: no task sees all copies of a unit. Which
    copy has which number may differ between runs, but copies are alike.
    """
    if again is None:
        return rows.withColumn(copy, F.lit(0).cast("long"))
    part, nth, n = (unused_name(rows, x) for x in ("part", "nth", "before"))
    names = again.select(F.col("unit").alias(unit))
    plain = rows.join(names, unit, "left_anti").withColumn(copy, F.lit(0).cast("long"))
    kept = materialize(rows.join(names, unit, "left_semi").withColumn(part, F.spark_partition_id()), "copied")
    by = Window.partitionBy(unit).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = kept.groupBy(unit, part).agg(F.count("*").alias(n)).withColumn(n, F.coalesce(F.sum(n).over(by), F.lit(0)))
    placed = kept.withColumn(nth, F.row_number().over(Window.partitionBy(unit, part).orderBy(unit))).join(before, [unit, part])
    placed = placed.withColumn(copy, (F.col(n) + F.col(nth) - 1).cast("long"))
    return plain.unionByName(placed.select(*plain.columns))


def _last_digit(units: DataFrame, spark, states: list[tuple], digit: int, ranked: bool) -> dict:  # noqa: ANN001
    """Per source of ``states`` (source, rows, lo, width, left, ranks): in which of the BLOCKS parts of its stretch ``left`` is met.

    Parts are taken by ``ranks`` if ``ranked``, else in order. Gives (part, its words' start, its documents).
    """
    state = spark.createDataFrame(states, "source string, rows long, lo long, width long, left long, ranks array<int>")
    at = _with_sources(units, state, "s", len(states)).filter("spot >= s.lo and spot < s.lo + s.width")
    part = F.shiftright(F.col("spot") - F.col("s.lo"), BITS - DIGIT * (digit + 1)).cast("int")
    parts = at.groupBy("source", part.alias("part")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("s.left").alias("left"), F.first("s.ranks").alias("ranks"))
    order = F.element_at("ranks", F.col("part") + 1) if ranked else F.col("part")
    start = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = parts.withColumn("start", start).filter("start <= left and left < start + size")
    return {r["source"]: (r["part"], r["start"], r["n"]) for r in met.select("source", "part", "start", "n").collect()}


def draws(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, shards: int = 16, seed: int = 7, into: str = "drawn") -> DataFrame:
    """All rows and columns of ``docs`` with what the mix takes of them, a struct ``into``.

    It has size (words), source_size, target, quota (the source's drawn blocks), quotas (those of each shard) and draws:
    an array of (pass, block, shard, words) with one entry for each time the mix takes the row. All rows of a source that
    one pass draws in one block go to one shard. words is the whole size but for at most one row of each source, of which
    only the first words are taken so that the source meets its target, to the rounding. Rows are drawn one by one, also
    where they repeat or have no doc_id. Null texts have no words; a null source is a source; an empty table gives an
    empty one. Very long texts are only counted and cut. Results depend on the rows alone, not on their order or
    partitions. ``docs`` may have columns of any name but ``into``.
    """
    spark = docs.sparkSession
    if into in docs.columns:
        raise ValueError(f"documents have a column {into}: choose another name for what is drawn")
    unit = unused_name(docs, "unit")
    keyed = docs.withColumn(unit, _unit())
    narrow = materialize(keyed.select(F.col(unit).alias("unit"), F.col("source").cast("string").alias("source"), word_count(text_or_empty()).alias("size")), "words")
    again = materialize(narrow.groupBy("unit").agg(F.count("*").alias("n"), F.first("source").alias("source"), F.first("size").alias("size")).filter("n > 1"), "copies")
    if again.isEmpty():
        again, units = None, narrow.withColumn("copy", F.lit(0).cast("long"))
    else:
        runs = again.withColumn("run", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})"))).repartition("unit", "run")
        copies = runs.select("unit", "source", "size", F.explode(F.expr(f"sequence(run * {COPIES}, least(run * {COPIES} + {COPIES - 1}, n - 1))")).alias("copy"))
        units = narrow.join(again.select("unit"), "unit", "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(copies)
    units = units.withColumn("spot", _spot(seed, "unit", "copy"))
    found = {r["source"]: (r["size"], r["n"]) for r in narrow.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    order = sorted(found, key=lambda s: (s is None, s or ""))
    size_of, rows_of = {s: found[s][0] for s in order}, {s: found[s][1] for s in order}
    target = source_targets(size_of, weights, most)
    full, need, ranks = {}, {}, {}
    for i, s in enumerate(order):
        full[s] = min(most, int(target[s] // size_of[s])) if size_of[s] else 0
        need[s] = round(target[s] - full[s] * size_of[s]) if size_of[s] and full[s] < most else 0
        if size_of[s] and need[s] >= size_of[s]:
            full[s], need[s] = full[s] + 1, 0
        ranks[s] = [int(x) for x in np.random.default_rng((seed, i)).permutation(BLOCKS)]

    # blocks of lower rank are drawn; of the block ranked ``whole``, what lies below ``low``, and of [low, low + width) a part
    whole, low, width, left = dict.fromkeys(order, 0), dict.fromkeys(order, 0), dict.fromkeys(order, 1 << BITS), dict(need)
    open_ones = [s for s in order if need[s] > 0]
    for digit in range(BITS // DIGIT):
        if not open_ones:
            break
        met = _last_digit(units, spark, [(s, rows_of[s], low[s], width[s], left[s], ranks[s]) for s in open_ones], digit, digit == 0)
        still = []
        for s in open_ones:
            part, start, n = met[s]
            if digit == 0:
                whole[s] = ranks[s][part]
            width[s] >>= DIGIT
            low[s] += part * width[s]
            left[s] -= start
            if left[s] and n > FEW:
                still.append(s)
        open_ones = still

    # the last places: whole documents while they fit, then the first words of the smallest left
    last = [s for s in order if left[s] > 0]
    state = spark.createDataFrame([(s, rows_of[s], low[s], width[s], left[s]) for s in last], "source string, rows long, lo long, width long, left long")
    few = _with_sources(units, state, "s", len(last)).filter("spot >= s.lo and spot < s.lo + s.width")
    listed = few.groupBy("source").agg(F.max("s.left").alias("left"), F.sort_array(F.collect_list(F.struct("spot", "unit", "copy", "size"))).alias("units"))
    took = F.expr("""aggregate(units, named_struct('left', left, 'took', cast(array() as array<boolean>)),
        (a, x) -> named_struct('left', if(x.size <= a.left, a.left - x.size, a.left), 'took', array_append(a.took, x.size <= a.left)))""")
    chosen = listed.select("units", took.alias("x")).select("units", "x.took", "x.left", F.expr("array_min(filter(transform(units, (u, i) -> if(x.left > 0 and not x.took[i], struct(u.size as size, i as i), null)), u -> u is not null)).i").alias("cut"))
    picked = chosen.select("took", "left", "cut", F.posexplode("units").alias("i", "u")).select(F.struct("u.unit.a", "u.unit.b", "u.copy").alias("one"), F.when(F.expr("took[i]"), F.col("u.size")).when(F.col("i") == F.col("cut"), F.col("left")).alias("words"))
    picked = picked.filter("words is not null")

    quotas = np.array([full[s] * BLOCKS + whole[s] + (left[s] > 0 or low[s] > ranks[s].index(whole[s]) << (BITS - DIGIT)) * (need[s] > 0) for s in order], np.int64)
    parted = split_quotas(quotas, shards, seed) if len(order) else np.zeros((shards, 0), np.int64)
    rng, rows = np.random.default_rng(seed + 1), []
    for i, s in enumerate(order):
        q = max(1, int(quotas[i]))
        step = next(a for a in iter(lambda q=q: int(rng.integers(1, q + 1)), None) if math.gcd(a, q) == 1)
        mine = [int(x) for x in parted[:, i]]
        rows.append((s, rows_of[s], size_of[s], target[s], full[s], whole[s] if need[s] else -1, low[s], ranks[s], int(quotas[i]), mine, step, int(rng.integers(q)), [int(x) for x in np.cumsum(mine)[:-1]]))
    plan = spark.createDataFrame(rows, "source string, rows long, source_size long, target double, full int, whole int, low long, ranks array<int>, quota long, quotas array<long>, mul long, plus long, ends array<long>")

    copy, of, own = unused_name(keyed, "copy"), unused_name(keyed, "plan"), unused_name(keyed, "own")
    out = _with_sources(_numbered(keyed, unit, copy, again), plan, of, len(order))
    out = out.withColumn(own, F.struct(word_count(text_or_empty()).alias("size"), _spot(seed, unit, copy).alias("spot"), F.struct(f"{unit}.a", f"{unit}.b", copy).alias("one")))
    words = unused_name(out, "words")
    picked = picked.select(F.col("one").alias(copy), F.col("words").alias(words))  # at most FEW rows a source, but for equal hashes
    out = out.drop(copy).withColumn(copy, F.col(f"{own}.one")).join(F.broadcast(picked) if len(order) <= BROADCAST_SOURCES else picked, copy, "left")
    block = f"cast(shiftright({own}.spot, {BITS - DIGIT}) as int)"
    rank = f"{of}.ranks[{block}]"
    taken = F.expr(f"""transform(
        filter(transform(sequence(0, {of}.full), p -> named_struct('pass', p, 'words',
            case when p < {of}.full or {rank} < {of}.whole or ({rank} = {of}.whole and {own}.spot < {of}.low) then {own}.size
                 when {words} is not null then {words} end)), d -> d.words is not null),
        d -> named_struct('pass', d.pass, 'block', {block}, 'shard', size(filter({of}.ends, e -> e <= pmod(
            (d.pass * {BLOCKS} + {rank}) * {of}.mul + {of}.plus, {of}.quota))), 'words', d.words))""")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(F.col(f"{own}.size").alias("size"), f"{of}.source_size", f"{of}.target", f"{of}.quota", f"{of}.quotas", taken.alias("draws")).alias(into))


def mix(docs: DataFrame, shards: int = 16, seed: int = 7, **options) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, one row for each time a document is taken, in shard order.

    Rows are dealt by (shard, hash), so consecutive partitions hold consecutive shards, each locally shuffled. The one
    document of a source that is taken in part keeps its first words, joined by single spaces (n_chars, if there,
    follows). Documents without words are never short of their target and go as their source's passes say. Odd inputs
    are as in :func:`draws`.
    """
    own = unused_name(docs, "drawn")
    d = draws(docs, shards=shards, seed=seed, into=own, **options)
    draw, order, shard = (unused_name(d, x) for x in ("draw", "order", "shard"))
    d = d.withColumn(draw, F.explode(f"{own}.draws"))
    part = F.col(f"{draw}.words") < F.col(f"{own}.size")
    cut = F.array_join(F.slice(F.filter(F.split("text", f"[{BLANKS}]+"), lambda w: w != ""), F.lit(1), F.col(f"{draw}.words").cast("int")), " ")
    d = d.withColumn("text", F.when(part, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(part, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    d = d.withColumns({shard: F.col(f"{draw}.shard"), order: F.xxhash64(F.lit(seed), "doc_id", "text", f"{draw}.pass")})
    return d.repartitionByRange(shard, order).sortWithinPartitions(shard, order).select(*[F.col(f"`{c}`") for c in docs.columns])
