"""Severity: ordered rules, calibration, escalation and majority votes over issues.

Issues have check_item, issue, severity, confidence, source_quote; null counts as ''.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: the rules, in order; the first that matches decides -----------------------------------------------
# (severity, substrings of check_item, the same in any case, substrings of issue, all of these in issue,
#  none of these in check_item, none of these in issue)
RULES = (
    ("critical", ("数值", "单位", "3.1", "3.2", "数字"), ("number",), ("数值", "单位", "测量"), (), (), ()),
    ("critical", ("错译", "1.4"), (), ("含义", "偏离", "误译为", "严重偏离", "改变"), (), (), ()),
    ("critical", ("客户术语", "0."), ("client",), (), (), (), ()),
    ("critical", ("术语统一", "4.3", "4.2"), (), ("术语不一致", "同一概念", "混用", "不同译法"), (), (), ()),
    ("critical", (), (), ("无法理解", "不通顺", "难以理解", "结构破碎", "不可读"), (), ("标点", "格式", "冗余", "空格"), ()),
    ("medium", ("2.5", "褒贬"), ("connotation",), (), (), (), ()),
    ("medium", ("翻译腔", "2.12", "被动直译", "2.13", "字面直译", "2.25"), (), (), ("直译", "翻译腔"), (), ()),
    ("medium", ("近义词", "2.6", "词义范围", "2.F1"), (), (), (), (), ()),
    ("medium", (), (), ("缺失", "残缺", "杂糅", "不完整"), (), (), ("无法理解",)),
    ("medium", ("2.23", "术语泛化", "MT术语"), (), (), ("泛化", "术语"), ("冗余", "标点", "格式"), ()),
    ("low", ("标点", "2.2", "2.3"), (), ("标点混用", "标点缺失", "标点多余", "括号", "引号"), (), (), ()),
    ("low", (), (), ("口语", "过于口语", "书面语"), (), (), ()),
    ("low", ("格式", "5.1", "5.2", "5.3", "空格", "字体", "行距"), (), ("空格",), (), (), ()),
    ("low", ("增译", "1.2", "2.18", "不同的", "冗余", "2.G3"), (), ("可有可无",), (), (), ()),
)
STYLE_ITEMS = ("2.3", "2.18", "2.19", "2.G3", "标点", "空格", "格式")
LEVELS = ("low", "medium", "critical")


def _any(c: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(n) for n in needles], F.lit(False))


def rule_severity(check_item: Column, issue: Column, severity: Column) -> Column:
    """The severity of the first rule that matches, style items at most medium; without a match, the given one."""
    ci, text = F.coalesce(check_item, F.lit("")), F.coalesce(issue, F.lit(""))
    style, out = _any(ci, STYLE_ITEMS), None
    for level, items, any_case, words, together, not_items, not_words in RULES:
        hit = _any(ci, items) | _any(F.lower(ci), any_case) | _any(text, words)
        if together:
            hit = hit | reduce(lambda a, b: a & b, [text.contains(w) for w in together])
        if not_items:
            hit = hit & ~_any(ci, not_items)
        if not_words:
            hit = hit & ~_any(text, not_words)
        value = F.when(style, "medium").otherwise("critical") if level == "critical" else F.lit(level)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.coalesce(severity, F.lit("medium")))


def majority(issues: DataFrame, group: str = "check_item", value: str = "severity", least: int = 3, share: float = 0.6) -> DataFrame:
    """``issues`` with the value that more than ``share`` of a group of ``least`` or more has, given to all of it.

    Votes are counted before they are shuffled and joined back, so a group of any size is a few rows. Ties for the most
    votes cannot exceed a share over a half.
    """
    votes = issues.groupBy(group, value).agg(F.count("*").alias("n"))
    won = votes.groupBy(group).agg(F.sum("n").alias("size"), F.max_by(value, F.struct("n", value)).alias("_winner"), F.max("n").alias("most"))
    won = won.filter((F.col("size") >= least) & (F.col("most") / F.col("size") > share)).select(group, "_winner")
    return issues.join(won, group, "left").withColumn(value, F.coalesce("_winner", value)).drop("_winner").select(*issues.columns)


def normalize(issues: DataFrame) -> DataFrame:
    """Rules, then: mistranslations are critical, uncertain critical ones medium, and groups vote. Keeps an audit."""
    rule = rule_severity(F.col("check_item"), F.col("issue"), F.col("severity"))
    rule = F.when(F.col("check_item").contains("错译"), "critical").otherwise(rule)
    rule = F.when((F.col("confidence") == "low") & (rule == "critical"), "medium").otherwise(rule)
    ruled = issues.withColumns({"original_severity": F.coalesce("severity", F.lit("medium")), "severity": rule})
    ruled = ruled.withColumn("ruled_severity", F.col("severity"))
    return majority(ruled)


# --- fixed values: what a domain's errors rise to; what justifies which severity; where another one is fine -----------------
ESCALATION = {
    "医疗器械注册": {"medical_term_error": "critical", "unit_conversion_error": "critical", "safety_related_error": "critical", "connotation_error": "medium", "punctuation_style": "low"},
    "药物临床": {"dose_error": "critical", "endpoint_error": "critical", "ae_term_error": "critical", "statistical_error": "critical", "terminology_inconsistency": "medium"},
    "网络安全评估": {"vulnerability_misclassification": "critical", "cvss_scoring_error": "critical", "authentication_bypass": "critical", "port_protocol_error": "medium", "terminology_inconsistency": "medium"},
    "安全数据表": {"hazard_misstatement": "critical", "cas_number_error": "critical", "concentration_error": "critical", "first_aid_error": "critical"},
    "专利文献": {"claim_scope_error": "critical", "legal_term_mistranslation": "critical", "figure_reference_error": "medium"},
    "": {
        "outright_mistranslation": "critical", "unit_conversion_error": "critical", "number_mismatch": "critical", "client_term_violation": "critical", "terminology_inconsistency": "medium",
        "connotation_error": "medium", "unnatural_expression": "low", "punctuation_style": "low",
    },
}
JUSTIFIES = {
    "critical": ("changes_meaning", "missing_unit_conversion", "breaks_sentence_structure", "terminology_inconsistency"), "medium": ("connotation_mismatch", "unnatural_expression"),
    "low": ("style_preference", "format_deviation"),
}
ALSO = (("critical", "connotation_mismatch"), ("critical", "unnatural_expression"))


def by_domain(docs: DataFrame, rules: DataFrame, names: list[str], key: str = "doc_id", primary: str = "primary") -> DataFrame:
    """``(key, columns of rules)``: the rows of ``rules`` (domain, ...) that hold for each document.

    They are those of the first of ``names``, the domains in order of precedence, that the document's primary domain
    holds; else those of domain ''. Names are a fixed list, so the domain is found in the row and rules meet it by equality.
    """
    known = F.filter(F.array(*[F.lit(n) for n in names if n]), lambda n: F.coalesce(F.col(primary), F.lit("")).contains(n))
    found = docs.select(key, F.coalesce(F.get(known, F.lit(0)), F.lit("")).alias("domain"))
    return found.join(F.broadcast(rules), "domain").select(key, *[c for c in rules.columns if c != "domain"])


def escalation_rules(docs: DataFrame, key: str = "doc_id", primary: str = "primary", table: dict[str, dict[str, str]] = ESCALATION) -> DataFrame:
    """``(key, error_type, target)``: to which severity errors of a document's domain rise."""
    rows = [(d, e, t) for d, kinds in table.items() for e, t in kinds.items()]
    return by_domain(docs, docs.sparkSession.createDataFrame(rows, "domain string, error_type string, target string"), list(table), key, primary)


#: Key terms of fewer characters lift nothing; items that are about terminology.
TERM_LENGTH, TERM_ITEMS = 4, ("术语", "4.1")


def escalate(issues: DataFrame, terms: DataFrame, rules: DataFrame, key: str = "doc_id") -> DataFrame:
    """Issues of documents with rules go up one level if they name a key term of their document.

    ``terms`` (key, source) are each document's key terms, a few dozen; ``rules`` (key, error_type, ...) what holds for
    its domain: a document without any keeps its severities. ``reason`` is the first term by name, or medical_term_error
    where the domain has that rule, the item is about terminology and the term stands in the quote; null without a hit.
    ``escalated`` says whether the severity changed.
    """
    known = terms.filter(F.length("source") >= TERM_LENGTH).groupBy(key).agg(F.array_sort(F.collect_set(F.lower("source"))).alias("_terms"))
    held = rules.groupBy(key).agg(F.max(F.col("error_type") == "medical_term_error").alias("_medical"))
    quote = F.lower(F.coalesce("source_quote", F.lit("")))
    said = F.concat(F.lower(F.coalesce("issue", F.lit(""))), F.lit(" "), quote)
    in_text, in_quote = F.filter("_terms", lambda t: said.contains(t)), F.filter("_terms", lambda t: quote.contains(t))
    about = F.col("_medical") & _any(F.coalesce("check_item", F.lit("")), TERM_ITEMS) & (F.size(in_quote) > 0)
    hit = F.when(F.col("_medical").isNotNull() & (F.size(in_text) > 0), F.when(about, "medical_term_error").otherwise(F.get(in_text, F.lit(0))))
    now = F.coalesce("severity", F.lit("medium"))
    up = F.when(now == "low", "medium").when(now == "critical", "critical").otherwise("critical")
    d = issues.join(held, key, "left").join(known, key, "left").withColumn("reason", hit).drop("_medical", "_terms")
    return d.withColumns({"escalated": F.col("reason").isNotNull() & (now != "critical"), "severity": F.when(F.col("reason").isNotNull(), up).otherwise(F.col("severity"))})


def mismatches(issues: DataFrame, key: list[str], justifies: dict[str, tuple[str, ...]] = JUSTIFIES, also: tuple[tuple[str, str], ...] = ALSO) -> DataFrame:
    """``(key, check_item, severity, severity_justification, expected)``: issues whose severity their justification does not
    carry, by a table of rules with exceptions. Unknown or empty justifications and severities are none."""
    spark = issues.sparkSession
    rules = spark.createDataFrame([(j, s) for s, js in justifies.items() for j in js], "severity_justification string, expected string")
    fine = spark.createDataFrame(list(also), "severity string, severity_justification string")
    asked = issues.filter("severity <> '' and severity_justification <> ''").join(F.broadcast(rules.groupBy("severity_justification").agg(F.array_sort(F.collect_set("expected")).alias("expected"))), "severity_justification")
    odd = asked.filter(~F.array_contains("expected", F.col("severity"))).join(F.broadcast(fine), ["severity", "severity_justification"], "left_anti")
    return odd.select(*key, "check_item", "severity", "severity_justification", "expected")


def missing_dimensions(coverage: DataFrame, ids: DataFrame) -> DataFrame:
    """Check ids that ``coverage`` (check_id, checked) lacks or has unchecked."""
    return ids.join(coverage.filter("checked").select("check_id"), "check_id", "left_anti")


def outliers(issues: DataFrame, high_risk: DataFrame) -> DataFrame:
    """High-risk paragraphs (doc_id, paragraph_index, score) without an issue: the ten of highest score per document."""
    quiet = high_risk.join(issues.select("doc_id", "paragraph_index"), ["doc_id", "paragraph_index"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "paragraph_index"))
    return quiet.withColumn("nth", nth).filter("nth <= 10")
