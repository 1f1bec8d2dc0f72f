"""The whole gate over the review of a document: constraints are rows of a table, compiled into one pass.

A review is a row: a version, the dimensions it covered (a map), the paragraphs it covered, its issues (maps, as read
from JSON, so that fields may be missing or unknown) and its verdicts, beside what was to be covered. Each constraint says
which part must obey which rule; all of them become one array of findings per row, so the gate shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import bound


class Constraint(NamedTuple):
    """``check`` is what a finding is called, ``level`` error or warning, ``rule`` a name in RULES, ``args`` what it takes."""

    check: str
    level: str
    rule: str
    args: tuple[str, ...] = ()


# --- fixed values: ids of checks, values of fields, and what mechanical findings belong to --------------------------------
CHECK_IDS = (
    "0.客户术语合规", *(f"1.{i}" for i in range(1, 10)), *(f"2.{i}" for i in range(1, 28)), *(f"2.F{i}" for i in range(1, 5)), *(f"2.G{i}" for i in range(1, 5)),
    *(f"3.{i}" for i in range(1, 10)), *(f"4.{i}" for i in range(1, 6)), *(f"5.{i}" for i in range(1, 11)),
)
GROUPS = {"1.": "一.双语忠实度", "2.": "二.表达规范", "3.": "三.数字符号单位", "4.": "四.术语合规", "5.": "五.格式与表格"}
SEVERITIES = ("critical", "medium", "low")
JUSTIFICATIONS = (
    "changes_meaning", "missing_unit_conversion", "breaks_sentence_structure", "terminology_inconsistency", "connotation_mismatch", "unnatural_expression",
    "style_preference", "format_deviation",
)
CONFIDENCES = ("high", "medium", "low")
VERDICTS = ("confirmed", "false_positive", "needs_context", "unverifiable")
REQUIRED = ("paragraph_index", "dimension", "check_item", "severity", "severity_justification", "confidence", "source_quote", "target_quote", "issue", "suggestion")
FOUND_BEFORE = {
    "glossary_violations": ("4.1", "4.2", "4.3"), "client_glossary_violations": ("0.客户术语合规",), "number_mismatches": ("3.1", "3.2"), "symbol_issues": ("3.3", "3.4"),
    "format_issues": ("5.1", "5.2"), "unit_issues": ("3.3",),
}
VERSION = "2.21"

GATE = (
    Constraint("version_mismatch", "error", "version_other_than", (VERSION,)),
    Constraint("version_missing", "warning", "no_version"),
    Constraint("top_level_structure", "error", "absent_parts", ("dimension_coverage", "paragraph_coverage", "issues")),
    Constraint("dimension_coverage", "error", "dimensions_lack", CHECK_IDS),
    Constraint("dimension_coverage", "error", "unchecked_at_least", ("3", *CHECK_IDS)),
    Constraint("dimension_coverage", "warning", "none_where_found_before", tuple(f"{kind}={i}" for kind, ids in FOUND_BEFORE.items() for i in ids)),
    Constraint("paragraph_coverage", "error", "no_paragraphs"),
    Constraint("paragraph_coverage", "error", "status_other_than", ("clean", "has_issue")),
    Constraint("paragraph_coverage", "error", "paragraphs_lack"),
    Constraint("paragraph_coverage", "warning", "paragraphs_beyond"),
    Constraint("iron_law_E", "error", "no_paragraph_with", ("has_issue",)),
    Constraint("issues", "error", "fields_lack", REQUIRED),
    Constraint("issues", "warning", "fields_other_than", (*REQUIRED, "chapter", "type", "original_severity")),
    Constraint("issues", "error", "values_other_than", ("severity", *SEVERITIES)),
    Constraint("issues", "error", "values_other_than", ("severity_justification", *JUSTIFICATIONS)),
    Constraint("issues", "warning", "values_other_than", ("confidence", *CONFIDENCES)),
    Constraint("issues", "warning", "no_issues"),
    Constraint("phase3_verdicts", "warning", "no_sheet"),
    Constraint("phase3_verdicts", "error", "verdicts_lack"),
    Constraint("phase3_verdicts", "warning", "verdicts_beyond"),
    Constraint("phase3_verdicts", "error", "verdicts_other_than", VERDICTS),
    Constraint("phase3_verdicts", "error", "short_explanations", ("20",)),
    Constraint("phase3_verdicts_all_dismissed", "error", "none_confirmed"),
    Constraint("phase3_verdicts_near_zero", "warning", "few_confirmed", ("0.05",)),
    Constraint("verdict_copy_paste", "error", "explanations_repeat", ("0", "0.3", "3")),
    Constraint("verdict_low_uniqueness", "warning", "explanations_repeat", ("0.3", "0.5", "3")),
    Constraint("zero_issues", "error", "issues_at_most", ("0", "0")),
    Constraint("single_issue_warning", "warning", "issues_at_most", ("1", "30")),
    Constraint("low_issue_count_warning", "warning", "issues_at_most", ("2", "50")),
    Constraint("low_issue_density_warning", "warning", "density_under", ("2.0",)),
)
#: Of these checks a document has the first alone.
QUANTITY = ("zero_issues", "single_issue_warning", "low_issue_count_warning", "low_issue_density_warning")

_COVERED = "array<struct<paragraph_index:int,status:string>>"
_JUDGED = "array<struct<verdict_id:string,verdict:string,explanation:string>>"
_DIMENSIONS = "map<string,struct<checked:boolean,issues_found:int>>"
_none = lambda kind="array<string>": F.array().cast(kind)


def _dims() -> Column:
    return F.coalesce(F.col("dimension_coverage").cast(_DIMENSIONS), F.create_map().cast(_DIMENSIONS))


def _paragraphs() -> Column:
    return F.filter(F.coalesce(F.col("paragraph_coverage").cast(_COVERED), _none(_COVERED)), lambda p: p["paragraph_index"].isNotNull())


def _issues() -> Column:
    return F.coalesce(F.col("issues"), _none("array<map<string,string>>"))


def _verdicts() -> Column:
    return F.coalesce(F.col("verdicts").cast(_JUDGED), _none(_JUDGED))


def _numbers(paragraphs: Column) -> Column:
    return F.array_distinct(F.transform(paragraphs, lambda p: p["paragraph_index"]))


def _lits(args: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(a) for a in args])


def _one(test: Column, what: Column) -> Column:
    return F.when(test, F.array(what.cast("string"))).otherwise(_none())


def _field(issue: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(issue, F.lit(name)), F.lit(""))


def _lacking(issue: Column, fields: tuple[str, ...]) -> Column:
    """Names of the fields that an issue lacks or has empty; paragraph 0 is none."""
    lacks = lambda f: _field(issue, f).isin("", "0") if f == "paragraph_index" else _field(issue, f) == ""
    return F.array_compact(F.array(*[F.when(lacks(f), F.lit(f)) for f in fields]))


def _sheet() -> Column:
    """Whether there is a sheet of verdicts that are asked for."""
    return F.coalesce(F.size("expected_verdicts") > 0, F.lit(False))


def _zero_before(args: tuple[str, ...]) -> Column:
    hits = []
    for pair in args:
        kind, check = pair.split("=", 1)
        cover = F.try_element_at(_dims(), F.lit(check))
        there = F.coalesce(F.try_element_at("found_before", F.lit(kind)), F.lit(0)) > 0
        hits.append(F.when(there & cover["checked"] & (F.coalesce(cover["issues_found"], F.lit(0)) == 0), F.lit(check)))
    return F.array_distinct(F.array_compact(F.array(*hits)))


def _repeats(least: str, most: str, of: str) -> Column:
    said = F.filter(F.transform(_verdicts(), lambda v: F.trim(F.coalesce(v["explanation"], F.lit("")))), lambda e: e != "")
    share = lambda s: F.size(F.array_distinct(s)) / F.greatest(F.size(s), F.lit(1))
    return bound(said, lambda s: _one((F.size(s) >= int(of)) & (share(s) >= float(least)) & (share(s) < float(most)), F.round(share(s), 2)))


def _confirmed() -> Column:
    return F.size(F.filter(_verdicts(), lambda v: v["verdict"] == "confirmed"))


def _total() -> Column:
    """Paragraphs of the document, those asked for if they are known."""
    return F.greatest(F.coalesce(F.when(F.size("expected_paragraphs") > 0, F.size("expected_paragraphs")), F.size(F.coalesce(F.col("paragraph_coverage").cast(_COVERED), _none(_COVERED)))), F.lit(1))


def _beyond(have: Column, want: Column, test: Column) -> Column:
    return F.when(test, F.transform(F.array_except(have, want), lambda x: x.cast("string"))).otherwise(_none())


#: What offends against each rule: an array of texts, empty if nothing does.
RULES: dict[str, Callable[..., Column]] = {
    "version_other_than": lambda v: _one(~F.coalesce(F.col("version"), F.lit("")).isin("", v), F.col("version")),
    "no_version": lambda: _one(F.coalesce(F.col("version"), F.lit("")) == "", F.lit("version")),
    "absent_parts": lambda *parts: F.array_compact(F.array(*[F.when(F.col(p).isNull(), F.lit(p)) for p in parts])),
    "dimensions_lack": lambda *ids: F.array_except(_lits(ids), F.map_keys(_dims())),
    "unchecked_at_least": lambda n, *ids: bound(
        F.map_keys(F.map_filter(_dims(), lambda k, v: k.isin(*ids) & ~F.coalesce(v["checked"], F.lit(False)))), lambda u: F.when(F.size(u) >= int(n), F.array_sort(u)).otherwise(_none())
    ),
    "none_where_found_before": lambda *pairs: _zero_before(pairs),
    "no_paragraphs": lambda: _one(F.size(F.coalesce(F.col("paragraph_coverage").cast(_COVERED), _none(_COVERED))) == 0, F.lit("paragraph_coverage")),
    "status_other_than": lambda *ok: F.transform(F.filter(_paragraphs(), lambda p: ~F.coalesce(p["status"], F.lit("")).isin(*ok)), lambda p: p["paragraph_index"].cast("string")),
    "paragraphs_lack": lambda: _beyond(F.col("expected_paragraphs"), _numbers(_paragraphs()), (F.size("expected_paragraphs") > 0) & (F.size(_paragraphs()) > 0)),
    "paragraphs_beyond": lambda: _beyond(_numbers(_paragraphs()), F.col("expected_paragraphs"), F.size("expected_paragraphs") > 0),
    "no_paragraph_with": lambda status: _one((F.size(_paragraphs()) > 0) & ~F.exists(_paragraphs(), lambda p: F.coalesce(p["status"] == status, F.lit(False))), F.lit(status)),
    "fields_lack": lambda *fields: F.array_compact(F.transform(_issues(), lambda i: bound(_lacking(i, fields), lambda f: F.when(F.size(f) > 0, F.concat(F.lit("P"), _field(i, "paragraph_index"), F.lit(": "), F.array_join(f, ",")))))),
    "fields_other_than": lambda *fields: F.array_sort(F.array_distinct(F.flatten(F.transform(_issues(), lambda i: F.array_except(F.map_keys(i), _lits(fields)))))),
    "values_other_than": lambda field, *ok: F.transform(F.filter(_issues(), lambda i: ~_field(i, field).isin("", *ok)), lambda i: _field(i, field)),
    "no_issues": lambda: _one(F.size(_issues()) == 0, F.lit("issues")),
    "no_sheet": lambda: _one(F.col("expected_verdicts").isNull(), F.lit("expected_verdicts")),
    "verdicts_lack": lambda: _beyond(F.col("expected_verdicts"), F.transform(_verdicts(), lambda v: F.coalesce(v["verdict_id"], F.lit(""))), _sheet()),
    "verdicts_beyond": lambda: _beyond(F.transform(_verdicts(), lambda v: F.coalesce(v["verdict_id"], F.lit(""))), F.col("expected_verdicts"), _sheet()),
    "verdicts_other_than": lambda *ok: F.when(_sheet(), F.transform(F.filter(_verdicts(), lambda v: ~F.coalesce(v["verdict"], F.lit("")).isin(*ok)), lambda v: F.coalesce(v["verdict_id"], F.lit("")))).otherwise(_none()),
    "short_explanations": lambda least: F.when(
        _sheet(), F.transform(F.filter(_verdicts(), lambda v: F.regexp_count(F.coalesce(v["explanation"], F.lit("")), F.lit("[一-鿿]")) < int(least)), lambda v: F.coalesce(v["verdict_id"], F.lit("")))
    ).otherwise(_none()),
    "none_confirmed": lambda: _one(_sheet() & (_confirmed() == 0), F.size("expected_verdicts")),
    "few_confirmed": lambda share: _one(_sheet() & (_confirmed() > 0) & (_confirmed() / F.greatest(F.size("expected_verdicts"), F.lit(1)) < float(share)), _confirmed()),
    "explanations_repeat": _repeats,
    "issues_at_most": lambda n, over: _one((F.size(_issues()) <= int(n)) & (_total() > int(over)), F.size(_issues())),
    "density_under": lambda pct: _one(F.round(F.size(_issues()) * 100.0 / _total(), 1) < float(pct), F.size(_issues())),
}


def read_constraints(table: DataFrame) -> list[Constraint]:
    """Constraints of a table (check, level, rule, args array<string>), a row each, in order of ``pos``."""
    return [Constraint(r["check"], r["level"], r["rule"], tuple(r["args"] or ())) for r in table.orderBy("pos").collect()]


def _findings(constraints: tuple[Constraint, ...] | list[Constraint]) -> Column:
    """Array of (check, level, rule, offenders) of a row; of QUANTITY the first alone."""
    for c in constraints:
        if c.rule not in RULES or c.level not in ("error", "warning"):
            raise ValueError(f"no such constraint: {c}")
    all_of = F.array(*[F.struct(F.lit(c.check).alias("check"), F.lit(c.level).alias("level"), F.lit(c.rule).alias("rule"), F.coalesce(RULES[c.rule](*c.args), _none()).alias("offenders")) for c in constraints])
    first = lambda fs: F.array_min(F.transform(F.filter(fs, lambda f: f["check"].isin(*QUANTITY)), lambda f: F.array_position(_lits(QUANTITY), f["check"])))
    rest = lambda fs: bound(first(fs), lambda n: F.filter(fs, lambda f: ~f["check"].isin(*QUANTITY) | (F.array_position(_lits(QUANTITY), f["check"]) == n)))
    return bound(F.filter(all_of, lambda f: F.size(f["offenders"]) > 0), rest)


def findings(reviews: DataFrame, key: str = "doc_id", constraints: tuple[Constraint, ...] | list[Constraint] = GATE, shown: int = 5) -> DataFrame:
    """``(key, check, level, rule, n, offenders)``: a row per constraint that a review breaks, with the first offenders.

    ``reviews`` has version, dimension_coverage, paragraph_coverage, issues, verdicts, and beside them expected_paragraphs,
    expected_verdicts (null: not known) and found_before (mechanical findings by kind). Any of them may be null.
    """
    d = reviews.select(key, F.explode(_findings(constraints)).alias("f"))
    return d.select(key, "f.check", "f.level", "f.rule", F.size("f.offenders").alias("n"), F.slice("f.offenders", 1, shown).alias("offenders"))


def review_gate(reviews: DataFrame, key: str = "doc_id", constraints: tuple[Constraint, ...] | list[Constraint] = GATE) -> DataFrame:
    """``(key, errors, warnings, failed, re_review, passed)``: every review, passed if it breaks no constraint of level error.

    ``failed`` names the broken checks of level error; ``re_review`` the groups of dimensions without an issue, where
    issues are suspiciously few, but not none.
    """
    d = reviews.withColumn("_f", _findings(constraints))
    of = lambda level: F.filter("_f", lambda f: f["level"] == level)
    few = F.exists("_f", lambda f: f["check"].isin(*QUANTITY[1:]))
    silent = F.array_compact(F.array(*[F.when(~F.exists(F.map_entries(_dims()), lambda e: e["key"].startswith(p) & e["key"].isin(*CHECK_IDS) & (F.coalesce(e["value"]["issues_found"], F.lit(0)) > 0)), F.lit(name)) for p, name in GROUPS.items()]))
    return d.select(
        key, F.size(of("error")).alias("errors"), F.size(of("warning")).alias("warnings"), F.array_sort(F.array_distinct(F.transform(of("error"), lambda f: f["check"]))).alias("failed"),
        F.when(few, silent).otherwise(_none()).alias("re_review"), (F.size(of("error")) == 0).alias("passed"),
    )
