"""Column functions over what a page's layout tells: spans of a line, and characters of formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: fonts and characters of formulas, and the gap that is a blank as a share of the font's size ------------
FORMULA_FONT = r"(CM[^R]|MS.M|XY|MT|BL|RM|EU|LA|RS|LINE|LCIRCLE|TeX-|rsfs|txsy|wasy|stmary|.*Mono|.*Code|.*Ital|.*Sym|.*Math)"
FORMULA_CHAR = r"[\p{Lm}\p{Mn}\p{Sk}\p{Sm}\p{Zl}\p{Zp}\p{Zs}\x{370}-\x{3FF}]"
GAP = 0.3


def is_formula(font: Column, char: Column, fonts: str | None = None, chars: str | None = None) -> Column:
    """Whether a character belongs to a formula: it has no code of its own, or its font (without a subset's mark) or the
    character itself says so. ``fonts`` and ``chars`` are patterns of one's own. Null fonts and characters say nothing."""
    begins = lambda c, pattern: F.coalesce(c, F.lit("")).rlike(f"^(?:{pattern})")
    of_char = begins(char, chars) if chars else begins(char, FORMULA_CHAR) & (char != " ")
    return F.coalesce(begins(char, r"\(cid:") | begins(F.substring_index(font, "+", -1), fonts or FORMULA_FONT) | of_char, F.lit(False))


def joined_spans(spans: Column) -> Column:
    """A line's text from its spans (text, x0, x1, size) in order: blank ones go, and a gap of ``GAP`` sizes is a blank."""
    said = F.filter(spans, lambda s: F.trim(s["text"]) != "")
    begun = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("end"))
    near = lambda a, s: a["end"].isNull() | (s["x0"] - a["end"] < s["size"] * F.lit(GAP))
    step = lambda a, s: F.struct(F.concat(a["text"], F.when(near(a, s), "").otherwise(" "), s["text"]).alias("text"), s["x1"].cast("double").alias("end"))
    return F.trim(F.aggregate(said, begun, step)["text"])


def is_line(text: Column) -> Column:
    """Lines of one character are marks, not text."""
    return F.length(text) > 1
