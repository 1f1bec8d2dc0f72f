"""Trie of the conversations' prefixes, by chained digests.

A turn's digest covers its role and text; the digest of a prefix covers that of the prefix before it and its last turn's.
Equal prefixes have equal digests, so nodes are groups of (depth, digest) and texts are hashed before they would be
shuffled. Sums over subtrees go from nodes to all their ancestors. A node's representative is its smallest member; the
nodes that a conversation represents are the end of its own path, so their sums are added up along it first and each
conversation sends one total to each prefix above: never more rows than there are prefixes, at any length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import discard, materialize, skewed_lookup, text_or_empty

#: A conversation shares turns with the first of its FAMILY consecutive ids; at most MOST_SHARED of them.
FAMILY, MOST_SHARED = 5, 8
ROOT = hashlib.sha256(b"").digest()
_BATCH, _PIECE = 8192, 1 << 16


def shared_turns(conv_id: int) -> int:
    """How many turns a conversation takes from the first of its family."""
    return zlib.crc32(str(conv_id).encode()) % (MOST_SHARED + 1)


def no_turns(conv_id: int) -> int:
    """For tries of conversations as they are."""
    return 0


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a role and a text; the role's length in front keeps them apart."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def prefixes(conversations: DataFrame, shared: Callable[[int], int] = shared_turns) -> DataFrame:
    """``(conv_id, depth, digest, parent, n_bytes, ends)``: every prefix of every rebuilt conversation, the empty one too.

    Conversation c is rebuilt as the first ``shared(c)`` turns of conversation c - c % 5, then its own turns after as
    many. Families come together and in order, and are read as a stream: no more than MOST_SHARED turns are kept.
    """
    c = F.col("conv_id").cast("long")
    role, text = text_or_empty("role"), text_or_empty("text")
    turns = conversations.select(c.alias("conv_id"), F.col("turn"), turn_digest(role, text).alias("own"), F.octet_length(text).cast("long").alias("n_bytes")).filter("conv_id is not null")
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    order = ["family", "later", "conv_id", F.asc_nulls_first("turn"), "own"]
    dealt = turns.withColumns({"family": family, "later": F.col("conv_id") != family}).repartition("family").sortWithinPartitions(*order)
    schema = "conv_id long, depth long, digest binary, parent binary, n_bytes long, ends boolean"

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        family = conv = digest = None
        first: list[tuple] = []  # the first turns of the family's first conversation
        depth = nth = skip = 0
        held: tuple | None = None  # the last prefix, until it is known whether the conversation goes on

        def push(own: bytes, n: int) -> Iterator[tuple]:
            nonlocal digest, depth, held
            yield (*held, False)
            parent, digest, depth = digest, hashlib.sha256(digest + own).digest(), depth + 1
            held = (conv, depth, digest, parent, n)

        for b in batches:
            for f, c, own, n in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if c != conv:
                    if held:
                        out.append((*held, True))
                    if f != family:
                        family, first = f, []
                    conv, digest, depth, nth, skip = c, ROOT, 0, 0, 0 if c == f else shared(c)
                    held = (c, 0, ROOT, None, 0)
                    for turn in first[:skip]:
                        out += push(*turn)
                nth += 1
                if c == f and len(first) < MOST_SHARED:
                    first.append((own, n))
                if nth > skip:
                    out += push(own, n)
                if len(out) >= _BATCH:
                    yield _batch(out)
                    out = []
        if held:
            out.append((*held, True))
        if out:
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "depth", "digest", "parent", "n_bytes", "ends"])

    return dealt.select("family", "conv_id", "own", "n_bytes").mapInArrow(chain, schema)


def hashed_lists(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, sha256)``: of the values per key, which differ, as decimal numbers in ascending order joined by commas.

    Rows are dealt by ranges of (key, value), so a key of any size is spread; each task joins its values to pieces of a
    bounded length. Pieces are few; those of a key are hashed one after another.
    """
    pieces_of = f"`{key}` binary, at long, piece string"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, held, size = None, 0, [], 0
        for b in batches:
            out = []
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != now or size >= _PIECE:
                    if held:
                        out.append((now, at, ",".join(held)))
                    now, at, held, size = k, v, [], 0
                held.append(str(v))
                size += len(held[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[key, "at", "piece"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([at]), pa.array([",".join(held)])], names=[key, "at", "piece"])

    def hash_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = sha = None
        for b in batches:
            out = []
            for k, piece in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k == now:
                    sha.update(b",")
                else:
                    if sha:
                        out.append((now, sha.hexdigest()))
                    now, sha = k, hashlib.sha256()
                sha.update(piece.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[key, "sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], names=[key, "sha256"])

    pieces = rows.select(key, value).repartitionByRange(key, value).sortWithinPartitions(key, value).mapInArrow(join, pieces_of)
    return pieces.repartition(key).sortWithinPartitions(key, "at").mapInArrow(hash_up, f"`{key}` binary, sha256 string")


def trie(conversations: DataFrame, shared: Callable[[int], int] = shared_turns) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, digest)``: a row per node.

    Turns are ordered by ``turn``, nulls first, equal ones by their digests; rows that repeat are turns of their own.
    Null roles and texts are empty. Rows without a conv_id belong to no conversation and take no part. A conversation
    of any length is read as a stream, in one task with its family; nodes of any number of members are grouped by sums
    that are added up before a shuffle. An empty table has no root and gives an empty one. Other columns are not looked at.
    """
    paths = materialize(prefixes(conversations, shared), "prefixes")
    nodes = paths.groupBy("depth", "digest").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("ends").cast("long")).alias("n_ends"), F.first("parent").alias("parent"),
        F.max("n_bytes").alias("n_bytes"),
    )
    nodes = materialize(nodes, "nodes")
    total = nodes.count()

    # what a conversation's own nodes hold from each depth down; its last node has no child if all its members end there
    down = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    saved = (F.col("n_convs") - 1) * F.col("n_bytes")
    own = nodes.select(
        "conv_id", "depth", "digest", "parent", F.sum(saved).over(down).alias("saved"), F.row_number().over(down).alias("up"),
        F.first(F.col("n_ends") == F.col("n_convs")).over(down).cast("long").alias("leaf"), F.min("depth").over(Window.partitionBy("conv_id")).alias("top"),
    )
    own = materialize(own, "own")
    heads = own.filter("depth = top")
    above = paths.select("conv_id", "depth", "digest").join(heads.select("conv_id", "top", "saved", "leaf"), "conv_id").filter("depth < top")
    sums = above.select("depth", "digest", "saved", "leaf", (F.col("depth") + 1 == F.col("top")).cast("long").alias("child"))
    sums = sums.unionByName(own.select("depth", "digest", "saved", "leaf", (F.col("up") > 1).cast("long").alias("child")))
    sums = sums.groupBy("depth", "digest").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"), F.sum("child").alias("n_children"))

    # the parent of all but a conversation's first own node is its own; that one's is looked up, and may have many children
    parents = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    branches = materialize(heads.filter("depth > 0").select("depth", "digest", "parent"), "branches")
    parents = branches.groupBy("parent").agg(F.count("*").alias("n")).join(parents, "parent")
    found = skewed_lookup(branches, parents, "parent", "n", total).select("depth", "digest", "parent_conv_id")
    listed = hashed_lists(paths.filter("ends"), "digest", "conv_id")

    key = ["depth", "digest"]
    all_of = nodes.select(*key, "conv_id", "n_convs").join(sums, key).join(found, key, "left").join(listed, "digest", "left")
    inner = own.select(*key, (F.col("depth") > F.col("top")).alias("inner"))
    parent = F.when(F.col("inner"), F.col("conv_id")).otherwise(F.col("parent_conv_id"))
    ends = F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    out = all_of.join(inner, key).select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256"), "digest")
    out = materialize(out, "trie")
    discard(paths, nodes, own, branches)
    return out


def _sql_crc32(number: str) -> str:
    """CRC-32 of a number in decimal digits, bit by bit: its polynomial is the fixed value."""
    step = "lambda r, i: xor(r >> 1, 3988292384 * (r & 1))"
    byte = f"lambda r, b: list_reduce(range(8), {step}, xor(r, b))"
    return f"xor(list_reduce(list_transform(string_split({number}::VARCHAR, ''), lambda ch: unicode(ch)::BIGINT), {byte}, 4294967295::BIGINT), 4294967295)"


#: The same trie over whole prefixes instead of digests.
ORACLE = f"""
WITH own AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns FROM conversations GROUP BY conv_id),
h AS (SELECT c, turns, CASE WHEN c % 5 = 0 THEN 0 ELSE {_sql_crc32('c')} % 9 END AS h FROM own),
rebuilt AS (SELECT a.c, list_concat(coalesce(list_slice(b.turns, 1, a.h), []), list_slice(a.turns, a.h + 1, len(a.turns))) AS t FROM h a LEFT JOIN own b ON b.c = a.c - a.c % 5),
path AS (SELECT c, len(t) AS n, d, t[1:d] AS p FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)),
node AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN n = d THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256
  FROM path GROUP BY p, d),
child AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2),
worth AS (
  SELECT node.*, coalesce(child.n, 0) AS n_children, CASE WHEN node.d = 0 THEN 0 ELSE (n_convs - 1) * strlen(node.p[node.d].t) END AS saved
  FROM node LEFT JOIN child ON node.p = child.p AND node.d = child.d),
below AS (SELECT p[1:a] AS p, a AS d, saved, n_children FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM worth)),
sums AS (SELECT p, d, sum(saved) AS saved_tokens, sum((n_children = 0)::INT) AS n_leaves FROM below GROUP BY p, d)
SELECT w.conv_id, w.d::BIGINT AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM worth w JOIN sums s ON s.p = w.p AND s.d = w.d LEFT JOIN worth u ON w.d > 0 AND u.d = w.d - 1 AND u.p = w.p[1:w.d - 1]"""
