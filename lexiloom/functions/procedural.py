"""Functions whose result depends on an order of steps within one text: vectorised, on Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

# --- fixed values: formats of items that a translation must keep, in the order they claim text ----------------------
TEMPERATURE = r"\d+\s*[°℃]\s*[CF]\s*(?:\(\s*\d+\s*[°℃]\s*[CF]\s*\))?|\d+\s*[°℃](?:\s*[CF])?|@\s*\d+\s*[°℃](?:\s*[CF])?"
ITEM_FORMATS = (  # category, format, whether the whole span or just its start is claimed
    ("temperature", TEMPERATURE, False),
    ("regulation", r"§\s*\d+(?:\.\d+)*(?:\s*CFR\s*\d+(?:\.\d+)*)?|\d+\s*CFR\s*\d+(?:\.\d+)*", True),
    ("cas_number", r"\b\d{2,7}-\d{2}-\d\b", True),
    ("email", r"\S+@\S+\.\S+", True),
    ("phone", r"\+\d[\d\s\-\(\)\.]{6,20}", True),
    ("number_with_unit", r"\d+(?:\.\d+)?\s*(?:mm\s*Hg|g/l|mg|kg|ml|L|℃|°C|°F|ppm|ppb|m/s|kPa|bar|atm|h|min|s)\b", False),
    ("decimal_number", r"(?<!\w)\d+\.\d+(?!\w)", False),
    ("percentage", r"\d+(?:\.\d+)?\s*%", False),
    ("symbol", r"[<>≤≥±≈×÷]", False),
    ("chemical", r"\b(?:[A-Z][a-z]?\d*){2,}\b", False),
    ("version", r"\bV\d+(?:\.\d+)*\b", False),
)
# fixed values: capitals that look like formulas and are none
NOT_CHEMICAL = {
    "THE", "AND", "FOR", "NOT", "ARE", "WAS", "HAS", "ALL", "USE", "USA", "ISO", "EN", "GHS", "US", "NIOSH", "OSHA",
    "HMIS", "NFPA", "ANSI", "VOC", "TSCA", "SDS", "MSDS", "CAS", "TOPAS", "IAF", "IMDG", "DOT", "ICAO", "TI", "EC",
    "JP", "NZ", "TW", "KR", "CN", "CA", "AU", "EU", "UN", "NO", "OK", "MI", "TX", "OH", "PA", "VA", "ID", "TOP",
    "END", "NEW", "OLD", "LOW", "HOT", "DRY", "WET", "CUT", "SET", "GET", "PUT", "RUN", "FIT", "SIT", "HIT", "BIT",
    "TIN", "ZIP", "OEM", "IF", "OR", "IN", "ON", "AT", "BY", "TO", "AS", "SO", "BE", "DO", "GO", "WE", "HE", "IT",
    "IS",
}
HIGH = frozenset({"temperature", "cas_number", "regulation", "number_with_unit", "decimal_number", "percentage"})

_FORMATS = tuple((c, re.compile(p), whole) for c, p, whole in ITEM_FORMATS)
# types as objects: workers import this module without a session
ITEM = StructType([StructField("category", StringType()), StructField("value", StringType()), StructField("position", IntegerType())])


def critical_items_of(text: str | None) -> list[dict]:
    """Items in the order of their formats; one that overlaps text claimed before is passed over."""
    taken, out = set(), []
    for category, pattern, whole in _FORMATS:
        for m in pattern.finditer(text or ""):
            a, b = m.span()
            if category == "chemical" and m[0].upper() in NOT_CHEMICAL:
                continue
            if category == "decimal_number" and a and text[a - 1] == "+":
                continue
            if taken.isdisjoint(range(a, b)):
                out.append({"category": category, "value": m[0], "position": a})
                taken.update(range(a, b) if whole else (a,))
    return out


@F.pandas_udf(ArrayType(ITEM))
def critical_items(texts: pd.Series) -> pd.Series:
    return texts.map(critical_items_of)


@F.pandas_udf(DoubleType())
def sequence_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp similarity; null counts as ''."""
    for a, b in batches:
        yield pd.Series([similarity(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)


#: Characters are counted by their code modulo this, so that counts have one size; that only makes bounds looser.
COUNTERS = 64


def counts_of(text: str | None) -> bytes:
    """How many characters of each kind a text has, as unsigned 32-bit numbers."""
    return np.bincount(np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32) % COUNTERS, minlength=COUNTERS).astype(np.uint32).tobytes()


@F.pandas_udf(BinaryType())
def character_counts(texts: pd.Series) -> pd.Series:
    """:func:`counts_of` each text; nulls count as ''."""
    return texts.map(counts_of, na_action=None)


def lowest_grams(size: int, most: int):
    """A function of texts: the ``most`` smallest hashes of each one's runs of ``size`` characters, smallest first."""

    @F.pandas_udf(ArrayType(LongType()))
    def run(texts: pd.Series) -> pd.Series:
        def of(text: str | None) -> np.ndarray:
            codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            n = max(0, len(codes) - size + 1)
            h = np.zeros(n, np.uint64)
            for k in range(size):  # wraps around
                h = (h ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            return np.unique(h.view(np.int64))[:most]

        return texts.map(of, na_action=None)

    return run


def common_in_order(a: str, b: str) -> int:
    """Length of the longest common subsequence, a column of the table at a time as bits of one number."""
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = free = (1 << len(a)) - 1
    for c in b:
        hit = free & places.get(c, 0)
        free = (free + hit | free - hit) & full
    return len(a) - free.bit_count()


#: From this length of the second text on, characters that make up over a hundredth of it begin no match.
LONG_TEXT = 200


#: What :func:`beginnings` gives.
Beginnings = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


@lru_cache(maxsize=4)
def kinds_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Different characters of a text, and which of them stands where; a page meets many windows in turn."""
    return np.unique(codes_of(text), return_inverse=True)


def beginnings(b: str) -> Beginnings:
    """Characters of a second text that can begin a match: their codes, and where and how many their places are in the last array."""
    codes = codes_of(b)
    order = np.argsort(codes, kind="stable")
    at = np.flatnonzero(np.diff(codes[order], prepend=-1))
    n = np.diff(at, append=len(codes))
    if len(b) >= LONG_TEXT:
        rare = n <= len(b) // 100 + 1
        at, n = at[rare], n[rare]
    return codes[order[at]], at, n, order


#: Up to so many pairs of places are laid out at once, and from so large a part (characters by characters) on it pays.
MOST_PAIRS, LARGE_PART = 1 << 20, 1 << 16


def longest_run(codes: tuple[np.ndarray, np.ndarray], known: Beginnings, part: tuple[int, int, int, int]) -> tuple[int, int, int] | None:
    """Place in a first text, place in a second and size of the longest run of characters that can begin a match, within
    the parts from ``a0`` to ``a1`` and ``b0`` to ``b1``; None if their pairs are too many to lay out. ``codes`` are the
    different characters of the first text, and which of them stands where."""
    a0, a1, b0, b1 = part
    chars, at, n, order = known
    if not len(chars):
        return a0, b0, 0
    kinds, of = codes
    # looked up once for each kind of character
    k = np.minimum(chars.searchsorted(kinds), len(chars) - 1)
    k[chars[k] != kinds] = -1
    k = k[of[a0:a1]]
    i = (k >= 0).nonzero()[0]
    k = k[i]
    times = n[k]
    before = times.cumsum()
    if not len(i):
        return a0, b0, 0
    if before[-1] > MOST_PAIRS:
        return None
    wide, shift = a1 - a0 + 1, len(order)
    small = (wide + shift) * wide < 1 << 31
    j = order[np.arange(before[-1]) + np.repeat(at[k] - before + times, times)]
    i = np.repeat(i, times)
    if b1 - b0 < len(order):
        within = (j >= b0) & (j < b1)
        i, j = i[within], j[within]
        if not len(i):
            return a0, b0, 0
    # pairs in order of diagonal, then place: a run is a row of neighbours
    pairs = (i - j + shift) * wide + i
    if small:  # sorts faster
        pairs = pairs.astype(np.int32)
    pairs.sort()
    first = np.concatenate(([0], (pairs[1:] - pairs[:-1] != 1).nonzero()[0] + 1, [len(pairs)]))
    sizes = first[1:] - first[:-1]
    size = int(sizes.max())
    longest = pairs[first[:-1][sizes == size]]
    starts, diagonals = longest % wide, longest // wide - shift
    i0 = int(starts.min())
    return a0 + i0, i0 - int(diagonals[starts == i0].max()), size


def matched_characters(a: str, b: str, need: int = 0, known: Beginnings | None = None) -> int | None:
    """Characters in the blocks that Ratcliff and Obershelp's method finds: the longest common run, then those on either side.

    Of equally long runs the first in ``a``, then in ``b``, counts. Where frequent characters begin no match, only the
    places of rare ones are walked through, and runs grow over the others. None as soon as what is left on both sides of
    the blocks found is too short to bring them to ``need``. Runs of large parts are found on arrays, of small ones in loops.
    """
    chars, at, n, order = known = beginnings(b) if known is None else known
    codes, begin, places = kinds_of(a), None, {}
    total, todo, left = 0, [(0, len(a), 0, len(b))], min(len(a), len(b))
    while todo:
        if total + left < need:
            return None
        a0, a1, b0, b1 = part = todo.pop()
        run = longest_run(codes, known, part) if (a1 - a0) * (b1 - b0) >= LARGE_PART else None
        i0, j0, size = run or (a0, b0, 0)
        if run is None:
            if begin is None:
                places = {chr(c): order[x : x + y].tolist() for c, x, y in zip(chars.tolist(), at.tolist(), n.tolist(), strict=True)}
                begin = [i for i, c in enumerate(a) if c in places]
            runs, last = {}, -2
            for i in begin[bisect_left(begin, a0) : bisect_left(begin, a1)]:
                before, runs = (runs if i == last + 1 else {}), {}
                for j in places[a[i]]:
                    if j >= b1:
                        break
                    if j >= b0:
                        m = runs[j] = before.get(j - 1, 0) + 1
                        if m > size:
                            i0, j0, size = i - m + 1, j - m + 1, m
                last = i
        while i0 > a0 and j0 > b0 and a[i0 - 1] == b[j0 - 1]:
            i0, j0, size = i0 - 1, j0 - 1, size + 1
        while i0 + size < a1 and j0 + size < b1 and a[i0 + size] == b[j0 + size]:
            size += 1
        left -= min(a1 - a0, b1 - b0)
        if size:
            total += size
            for x in ((a0, i0, b0, j0), (i0 + size, a1, j0 + size, b1)):
                if x[0] < x[1] and x[2] < x[3]:
                    left += min(x[1] - x[0], x[3] - x[2])
                    todo.append(x)
    return total if total >= need else None


def similarity(a: str, b: str) -> float:
    """Twice the matched characters over all characters; 1 for two empty texts."""
    return 2.0 * matched_characters(a, b) / (len(a) + len(b)) if a or b else 1.0


def ratio_that_wins(a: str, b: str, least: float, ties: bool, known: Beginnings | None = None) -> float | None:
    """Similarity of two texts if it is above ``least``, or equal to it with ``ties``; else None.

    Matching blocks are a common subsequence, so what two texts have in order bounds their similarity; with a long
    second text comparing takes less time than the bound. A text that begins the other, or stands anywhere in it if
    every character of the second can begin a match, is one block.
    """
    wins = lambda r: r > least or ties and r == least
    both, short = len(a) + len(b), min(len(a), len(b))
    if not both:
        return 1.0 if wins(1.0) else None
    if not wins(2.0 * short / both):
        return None
    if a.startswith(b) or b.startswith(a) or len(b) < LONG_TEXT and (b in a or a in b):
        return 2.0 * short / both
    if least > 0 and len(b) < LONG_TEXT and not wins(2.0 * common_in_order(a, b) / both):
        return None
    need = max(0, int(least * both / 2) - 1)
    while not wins(2.0 * need / both):
        need += 1
    matched = matched_characters(a, b, need, known)
    return None if matched is None else 2.0 * matched / both


def best_window(page: str, counts: np.ndarray, windows: list[str], at: np.ndarray, begun: dict[int, Beginnings]) -> tuple[int, float]:
    """Of different texts, the number ``at`` and similarity of the one most like a page, of equals the smallest number.

    ``counts`` are the characters of each window. Those that a page and a window both have, in any order, bound their
    similarity; windows are compared from the highest bound on, first those that hold the page or stand in it, until none
    left can win. ``begun`` keeps the beginnings of windows between pages.
    """
    own = np.frombuffer(counts_of(page), np.uint32).astype(np.int64)
    size = counts.sum(axis=1)
    total, shared = size + own.sum(), np.minimum(counts, own).sum(axis=1)
    most = np.where(total > 0, 2.0 * shared / np.maximum(total, 1), 1.0)
    order = np.lexsort((at, -most))
    inside = [k for k in order[(shared == np.minimum(size, own.sum()))[order]].tolist() if windows[k] in page or page in windows[k]]
    seen, best, of = set(inside), -1.0, -1
    for some in (inside, [k for k in order.tolist() if k not in seen]):
        for k in some:
            if most[k] < best:
                break
            ties = bool(at[k] < of)
            if most[k] > best or ties:
                if k not in begun:
                    begun[k] = beginnings(windows[k])
                r = ratio_that_wins(page, windows[k], best, ties, begun[k])
                if r is not None:
                    best, of = r, int(at[k])
    return of, best


FOUND = StructType([StructField("start", IntegerType()), StructField("similarity", DoubleType())])


@F.pandas_udf(ArrayType(FOUND))
def best_windows(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """For each page of a document the start of the window most like it, and how like: of its texts of pages and of
    paragraphs, the size of a window and the step between two. Equal texts of pages, and of windows, are compared once."""
    for pages, paragraphs, sizes, steps in batches:
        out = []
        for mine, texts, size, step in zip(pages, paragraphs, sizes, steps, strict=True):
            first: dict[str, int] = {}
            for start in range(0, len(texts), step):
                first.setdefault(" ".join(t for t in texts[start : start + size] if t is not None), start)
            windows, at, begun, known = list(first), np.array(list(first.values())), {}, {}
            counts = np.frombuffer(b"".join(map(counts_of, windows)), np.uint32).reshape(len(windows), -1).astype(np.int64)
            for page in mine:
                if page not in known:
                    known[page] = best_window(page, counts, windows, at, begun)
            out.append([{"start": s, "similarity": r} for s, r in map(known.get, mine)])
        yield pd.Series(out, dtype=object)


@F.pandas_udf(DoubleType())
def ratio_above(texts: pd.Series, others: pd.Series, least: pd.Series, ties: pd.Series) -> pd.Series:
    """:func:`ratio_that_wins` for each row; null texts count as '', and with a null ``least`` there is nothing to win."""
    return pd.Series([None if pd.isna(x) else ratio_that_wins(a or "", b or "", x, t) for a, b, x, t in zip(texts, others, least, ties, strict=True)], dtype=float)


_PART = re.compile(r"\\Q.*?(?:\\E|$)|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]?|.|\\", re.S)


def literal_of(pattern: str) -> str:
    """The longest run of characters that every match of a pattern holds; '' if none is sure.

    Groups, classes and escapes other than of signs end a run; an optional or repeated character leaves it. A pattern with
    alternatives outside groups, or with flags that change what stands for what, has none.
    """
    runs, run, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "|" or pattern.startswith(("(?x", "(?ix", "(?xi"), i):
            return ""
        if c in "([":
            depth = 0
            while i < len(pattern):
                part = _PART.match(pattern, i)[0]
                if part[0] == "[" and "[" in part[1:].replace("\\[", ""):  # a class within a class
                    return ""
                depth += (part == "(") - (part == ")")
                i += len(part)
                if depth <= 0:
                    break
            runs, run = [*runs, run], ""
        elif c == "\\":
            nxt = pattern[i + 1 : i + 2]
            i += 2
            if nxt == "Q":
                end = pattern.find("\\E", i)
                end = len(pattern) if end < 0 else end
                run += pattern[i:end]
                i = end + 2
            elif nxt and not nxt.isalnum():
                run += nxt
            else:
                runs, run = [*runs, run], ""
                if nxt in "pPxuk" and pattern[i : i + 1] in "{<":
                    i = max(pattern.find("}", i), pattern.find(">", i)) + 1 or len(pattern)
                elif nxt == "x":
                    i += 2
                elif nxt in "u":
                    i += 4
                elif nxt in "pPc":
                    i += 1
                elif nxt == "0":
                    while pattern[i : i + 1].isdigit():
                        i += 1
        elif c in "*?{":
            runs, run = [*runs, run[:-1]], ""
            i = (pattern.find("}", i) if c == "{" else i) + 1 or len(pattern)
        elif c in "+.^$)]}":
            runs, run = [*runs, run], ""
            i += 1
        else:
            run += c
            i += 1
    return max([*runs, run], key=len)


@F.pandas_udf(StringType())
def longest_literal(patterns: pd.Series) -> pd.Series:
    """:func:`literal_of` for the patterns of a glossary."""
    return patterns.map(lambda p: literal_of(p or ""))


def packed_lines(text: str | None, most: int) -> list[str]:
    """Lines joined greedily while the sum of lengths stays under ``most``."""
    out, cur = [], ""
    for line in (text or "").split("\n"):
        if cur and len(cur) + len(line) >= most:
            out.append(cur)
            cur = line
        else:
            cur = f"{cur}\n{line}" if cur else line
    return [*out, cur] if cur else out


def pack_lines(most: int):
    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: packed_lines(t, most))

    return run
