"""Removal of chunks of lines that occur elsewhere in the corpus.

A text is broken into lines after each newline and each sentence end, blanks included, so that passages inside
paragraphs count too. Chunks begin where a rolling hash over the hashes of two lines is higher than before and after;
a run of one line is cut in twos; paragraphs of several lines, runs of one-line paragraphs, and lines of LONG or more
characters also begin and end chunks, and leave no first or last line alone. All this depends on a few lines around, so a
repeated paragraph is chunked alike everywhere, and a passage inside paragraphs is from its second or third line on.
Chunks of several lines, and long lines, that occur more than once, anywhere, are compared byte by byte, but for the
blanks at their ends; the occurrence of the smallest doc_id and place stays, the others go, and with them lines next to
them that equal those next to the one that stays.

DataFrame operations only. A text is parsed once for its chunks, of which places and hashes alone are written and
counted; only texts with a repeated hash are parsed again, for the bytes to compare, and those that lose a chunk, to cut
them. Whole texts are shuffled twice. Every step is linear in a text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import discard, materialize, skewed_lookup, unused_name

#: Blanks that end a line belong to it, and do not count when lines and chunks are compared.
ENDS = r"[ \t\n\r\f]"
LINE = rf"[^\n.!?]*(?:[.!?]+{ENDS}*|\n{ENDS}*|\z)"
#: A line of so many characters, some 40 words, is a chunk of its own and counts as several lines.
LONG = 200

_TRIM = r"rtrim(' \t\n\r\f', {})"
#: All matches but the empty one at the end.
_LINES = "element_at(transform(array(regexp_extract_all(coalesce({}, ''), r'" + LINE + "', 0)), m -> slice(m, 1, size(m) - 1)), 1)"
_BARE = f"transform(lines, u -> {_TRIM.format('u')})"
_HASHES = "transform(bare, u -> cast(conv(substring(md5(u), 1, 8), 16, 10) as bigint))"
#: L: long, e: ends a paragraph, s: goes on.
_KINDS = r"transform(lines, (u, i) -> if(length(bare[i]) >= " + str(LONG) + r", 'L', if(contains(u, '\n') or i = size(lines) - 1, 'e', 's')))"
#: f: begins a chunk in any case, c: begins one unless that leaves a line alone, n: does not.
_ROLLS = "transform(hashes, (h, i) -> (h * 1000003 + coalesce(get(hashes, i + 1), 0L)) % 2147483647)"
_MARKS = """array_join(transform(rolls, (r, i) -> case
    when i = 0 or kinds[i - 1] = 'L' or kinds[i] = 'L' or (kinds[i - 1] = 'e' and (kinds[i] = 's' or (i > 1 and kinds[i - 2] = 's'))) then 'f'
    when r = rolls[i - 1] or (r > rolls[i - 1] and r > coalesce(get(rolls, i + 1), -1L)) then 'c' else 'n' end), '')"""
_BEGINS = "split(regexp_replace(regexp_replace(marks, 'c(f|$)', 'n$1'), '.([cn]?n*)', 'S$1'), '')"
_STARTS = "filter(sequence(1, size(lines)), i -> begins[i - 1] = 'S')"
_PLACES = "transform(starts, (s, j) -> struct(s as at, coalesce(get(starts, j + 1), size(lines) + 1) - s as n))"
_CHUNK = _TRIM.format("array_join(slice(lines, c.at, c.n), '')")
_CANDIDATES = f"transform(filter(places, c -> c.n > 1 or kinds[c.at - 1] = 'L'), c -> struct(c.at as at, c.n as n, unhex(md5({_CHUNK})) as h))"
#: Lines next to a chunk that are compared with those next to the one that stays: up to NEAR, of fewer than LONG characters,
#: none of another repeated chunk.
NEAR = 16
_SHORT = f"transform(lines, u -> if(length({_TRIM.format('u')}) < {LONG}, {_TRIM.format('u')}, null))"
_AROUND = f"""transform(chunks, (c, j) -> struct(c.h as h, c.at as at, c.n as n, {_CHUNK} as chunk,
    slice(short, greatest(1, c.at - {NEAR}, coalesce(get(chunks, j - 1).at + get(chunks, j - 1).n, 1)), c.at - greatest(1, c.at - {NEAR}, coalesce(get(chunks, j - 1).at + get(chunks, j - 1).n, 1))) as before,
    slice(short, c.at + c.n, least({NEAR}, size(lines) + 1 - c.at - c.n, coalesce(get(chunks, j + 1).at - c.at - c.n, {NEAR}))) as after))"""


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once however often the body reads it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def parsed(text: str = "text") -> Column:
    """(n_chunks, chunks) of a text; chunks, those that count, as (at: first line from 1, n: lines, h: MD5)."""
    body = f"struct(size(places) as n_chunks, {_CANDIDATES} as chunks)"
    for name, value in (("places", _PLACES), ("starts", _STARTS), ("begins", _BEGINS), ("marks", _MARKS), ("kinds", _KINDS), ("rolls", _ROLLS), ("hashes", _HASHES), ("bare", _BARE)):
        body = _let(name, value, body)
    none = "struct(0 as n_chunks, cast(array() as array<struct<at: int, n: int, h: binary>>) as chunks)"
    return F.expr(_let("lines", _LINES.format(text), f"if(size(lines) > 0, {body}, {none})"))


def _key() -> Column:
    """Rows that repeat both doc_id and text are one document: 128 bits name it."""
    text = F.coalesce("text", F.lit(""))
    return F.struct(F.xxhash64("doc_id", text).alias("a"), F.xxhash64(text, F.lit("key"), "doc_id").alias("b"))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """``(key, n_chunks, gone)`` of each document; gone: (at, lo, hi, kept_doc_id) of the chunks that go, ascending.

    at is a chunk's first line; lines lo to hi go with it. Hashes are counted before they are shuffled. Occurrences meet
    repeated hashes, and later those that stay, by a join that broadcasts the rows of hashes that hold at least one in
    HOT_SHARE of all occurrences (NEAR lines of fewer than LONG characters to either side). Bytes are grouped; a hash
    that two texts share repeats nothing.
    """
    rows = docs.select("doc_id", "text", _key().alias("key"))
    table = materialize(rows.select("doc_id", "key", parsed().alias("p")).select("doc_id", "key", "p.n_chunks", "p.chunks"), "parsed")
    chunks = table.select("doc_id", "key", F.explode("chunks").alias("c")).select("doc_id", "key", "c.at", "c.n", "c.h")
    seen = materialize(chunks.groupBy("h").agg(F.count("*").alias("times")).filter("times > 1"), "repeated")
    total = table.agg(F.coalesce(F.sum(F.size("chunks")), F.lit(0))).first()[0]
    found = skewed_lookup(chunks, seen, "h", "times", total, how="inner")

    # what a document collects is as long as its text
    wanted = found.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("at", "n", "h"))).alias("chunks"))
    around = F.expr(_let("lines", _LINES.format("text"), _let("short", _SHORT, _AROUND)))
    texts = rows.join(wanted, "key").select("key", "doc_id", F.explode(around).alias("c")).select("key", "doc_id", "c.*")
    texts = materialize(texts, "occurrences")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at", "key")  # the key decides between null or equal ids
    stays = F.min_by(F.struct("doc_id", "at", "key", "before", "after"), first).alias("kept")
    kept = texts.groupBy("h", "chunk").agg(F.count("*").alias("times"), F.min(first).alias("first"), stays).groupBy("h").agg(F.count("*").alias("texts"), F.max("times").alias("times"), F.min_by("kept", "first").alias("kept"))
    kept = materialize(kept.filter("texts = 1").select("h", "times", "kept"), "kept")

    again = skewed_lookup(texts.drop("chunk"), kept, "h", "times", texts.count(), how="inner").filter(~((F.col("key") == F.col("kept.key")) & (F.col("at") == F.col("kept.at"))))
    same = "coalesce(nullif(array_position(transform({a}, (u, i) -> coalesce(u = get({b}, i), false)), false), 0) - 1, size({a}))"
    lo, hi = F.expr("at - " + same.format(a="reverse(before)", b="reverse(kept.before)")), F.expr("at + n - 1 + " + same.format(a="after", b="kept.after"))
    gone = again.select("key", F.struct("at", lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), F.col("kept.doc_id").alias("kept_doc_id")).alias("g")).groupBy("key").agg(F.sort_array(F.collect_set("g")).alias("gone"))
    out = materialize(table.groupBy("key").agg(F.max("n_chunks").alias("n_chunks")).join(gone, "key", "left"), "gone")
    discard(table, seen, texts, kept)
    return out


def dedup_lines(docs: DataFrame, report: bool = False) -> DataFrame:
    """``docs``, all rows and columns, with the text less its repeated chunks (n_chars follows, if there).

    The occurrence of the smallest doc_id and place stays; all others go, each with the lines next to it that equal
    those next to the one that stays. With ``report``: also n_chunks (how many chunks there were), removed_chunks and
    kept_doc_id (who keeps the first of them, null if none went). A text of which nothing is left becomes empty. Null
    texts stay null, empty ones empty; an empty table gives an empty one. A text of any length is worked on in time
    linear in it, but in one task. Rows that repeat doc_id and text are one document: they keep alike. Null ids come
    last: one keeps a chunk only if no other document has it. Of different texts with null or equal ids one keeps it, too,
    the first by place and then by a hash of the text. Columns may have any name.
    """
    key, found = unused_name(docs, "key"), unused_name(docs, "found")
    gone = repeated_chunks(docs).select(F.col("key").alias(key), F.struct("n_chunks", "gone").alias(found))
    d = docs.withColumn(key, _key()).join(gone, key, "left")
    changed = F.coalesce(F.size(f"{found}.gone") > 0, F.lit(False))
    kept = f"transform(array_except(sequence(1, size(lines)), flatten(transform({found}.gone, g -> sequence(g.lo, g.hi)))), i -> lines[i - 1])"
    cut = F.expr(_let("lines", _LINES.format("text"), f"array_join({kept}, '')"))
    text = F.when(changed, cut).otherwise(F.col("text"))
    d = d.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], changed.alias(key), F.col(found))
    fresh = {}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(F.col(key), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    more = [
        F.col(found)["n_chunks"].cast("long").alias("n_chunks"),
        F.when(F.col(key), F.size(F.col(found)["gone"])).otherwise(0).cast("long").alias("removed_chunks"),
        F.when(F.col(key), F.col(found)["gone"][0]["kept_doc_id"]).alias("kept_doc_id"),
    ]
    return d.select(*[fresh.get(c, F.col(f"`{c}`")) for c in docs.columns], *(more if report else []))


#: What dedup_lines(report=True) gives for documents, as digests, by SQL of its own.
ORACLE = rf"""
WITH lined AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_extract_all(coalesce(text, ''), '{LINE}'), lambda u: u <> '') AS lines
  FROM documents),
bared AS (SELECT *, list_transform(lines, lambda u: rtrim(u, ' ' || chr(9) || chr(10) || chr(13) || chr(12))) AS bare FROM lined),
hashed AS (
  SELECT *, list_transform(bare, lambda u: ('0x' || substring(md5(u), 1, 8))::BIGINT) AS hashes,
    list_transform(lines, lambda u, i: CASE WHEN length(bare[i]) >= {LONG} THEN 'L' WHEN contains(u, chr(10)) OR i = len(lines) THEN 'e' ELSE 's' END) AS kinds
  FROM bared),
rolled AS (SELECT *, list_transform(hashes, lambda h, i: (h * 1000003 + coalesce(hashes[i + 1], 0)) % 2147483647) AS rolls FROM hashed),
marked AS (
  SELECT *, array_to_string(list_transform(rolls, lambda r, i: CASE
      WHEN i = 1 OR kinds[i - 1] = 'L' OR kinds[i] = 'L' OR (kinds[i - 1] = 'e' AND (kinds[i] = 's' OR (i > 2 AND kinds[i - 2] = 's'))) THEN 'f'
      WHEN r = rolls[i - 1] OR (r > rolls[i - 1] AND r > coalesce(rolls[i + 1], -1)) THEN 'c' ELSE 'n' END), '') AS marks
  FROM rolled),
begun AS (SELECT *, regexp_replace(regexp_replace(marks, 'c(f|$)', 'n\1', 'g'), '.([cn]?n*)', 'S\1', 'g') AS begins FROM marked),
started AS (SELECT *, list_filter(range(1, len(lines) + 1), lambda i: begins[i] = 'S') AS starts FROM begun),
placed AS (
  SELECT doc_id, lines, bare, kinds, unnest(list_transform(starts, lambda s, j: {{'pos': s, 'n': coalesce(starts[j + 1], len(lines) + 1) - s}})) AS c FROM started),
chunks AS (
  SELECT doc_id, lines, bare, c.pos AS pos, c.n AS n, rtrim(array_to_string(lines[c.pos:c.pos + c.n - 1], ''), ' ' || chr(9) || chr(10) || chr(13) || chr(12)) AS chunk
  FROM placed WHERE c.n > 1 OR kinds[c.pos] = 'L'),
repeated AS (SELECT * FROM chunks QUALIFY count(*) OVER (PARTITION BY chunk) > 1),
bounded AS (
  SELECT *, greatest(1, pos - {NEAR}, coalesce(lag(pos + n) OVER d, 1)) AS lo, least(len(lines) + 1, pos + n + {NEAR}, coalesce(lead(pos) OVER d, len(lines) + 1)) AS hi
  FROM repeated WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
around AS (
  SELECT doc_id, pos, n, chunk, list_reverse(CASE WHEN lo < pos THEN bare[lo:pos - 1] ELSE [] END) AS before, CASE WHEN hi > pos + n THEN bare[pos + n:hi - 1] ELSE [] END AS behind FROM bounded),
kept AS (SELECT *, first_value(doc_id) OVER w AS keeper, first_value(pos) OVER w AS kept_pos, first_value(before) OVER w AS kept_before, first_value(behind) OVER w AS kept_behind
  FROM around WINDOW w AS (PARTITION BY chunk ORDER BY doc_id, pos)),
gone AS (
  SELECT doc_id, pos, keeper,
    pos - coalesce(list_position(list_transform(before, lambda u, i: coalesce(u = kept_before[i] AND length(u) < {LONG}, false)), false) - 1, len(before)) AS lo,
    pos + n - 1 + coalesce(list_position(list_transform(behind, lambda u, i: coalesce(u = kept_behind[i] AND length(u) < {LONG}, false)), false) - 1, len(behind)) AS hi
  FROM kept WHERE NOT (doc_id = keeper AND pos = kept_pos)),
cuts AS (SELECT doc_id, count(*) AS removed_chunks, arg_min(keeper, pos) AS kept_doc_id, list_distinct(flatten(list(range(lo, hi + 1)))) AS gone FROM gone GROUP BY doc_id),
cleaned AS (
  SELECT s.doc_id, s.text, len(starts) AS n_chunks, removed_chunks, kept_doc_id,
    CASE WHEN removed_chunks IS NULL THEN s.text ELSE array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(c.gone, i)), lambda i: lines[i]), '') END AS clean
  FROM started s LEFT JOIN cuts c ON c.doc_id = s.doc_id)
SELECT doc_id, n_chunks::BIGINT AS n_chunks, coalesce(removed_chunks, 0)::BIGINT AS removed_chunks,
  (length(text) - length(clean))::BIGINT AS removed_chars, kept_doc_id, md5(clean) AS clean_md5
FROM cleaned
"""
