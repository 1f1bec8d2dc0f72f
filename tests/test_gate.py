"""The whole gate, rule by rule, and rule tables by domain."""

from __future__ import annotations

import pytest

from lexiloom.operators import constraints, context, severity

GOOD_ISSUE = dict.fromkeys(constraints.REQUIRED, "x") | {"paragraph_index": "1", "severity": "low", "severity_justification": "style_preference", "confidence": "high"}
LONG = "原文的数值与译文的数值完全一致只是写法不同因此这一条不是错误"
GOOD = {
    "version": "2.21", "dimension_coverage": {i: (True, 1) for i in constraints.CHECK_IDS}, "paragraph_coverage": [(1, "has_issue"), (2, "clean")], "issues": [GOOD_ISSUE],
    "verdicts": [("a", "confirmed", LONG), ("b", "false_positive", LONG + "一")], "expected_paragraphs": [1, 2], "expected_verdicts": ["a", "b"], "found_before": {"format_issues": 1},
}
SCHEMA = """doc_id int, version string, dimension_coverage map<string,struct<checked:boolean,issues_found:int>>, paragraph_coverage array<struct<paragraph_index:int,status:string>>,
issues array<map<string,string>>, verdicts array<struct<verdict_id:string,verdict:string,explanation:string>>, expected_paragraphs array<int>, expected_verdicts array<string>, found_before map<string,int>"""
DIMS = GOOD["dimension_coverage"]
CHANGES = {
    "nothing": ({}, []),
    "old version": ({"version": "2.20"}, [("version_mismatch", "error", 1)]),
    "no version": ({"version": None}, [("version_missing", "warning", 1)]),
    "no dimensions": ({"dimension_coverage": None}, [("top_level_structure", "error", 1), ("dimension_coverage", "error", len(constraints.CHECK_IDS))]),
    "two unchecked": ({"dimension_coverage": DIMS | {"1.1": (False, 0), "1.2": (False, 0)}}, []),
    "three unchecked": ({"dimension_coverage": DIMS | {"1.1": (False, 0), "1.2": (None, 0), "2.F1": (False, 0)}}, [("dimension_coverage", "error", 3)]),
    "none where found before": ({"dimension_coverage": DIMS | {"5.1": (True, 0), "4.1": (True, 0)}}, [("dimension_coverage", "warning", 1)]),
    "no paragraphs": ({"paragraph_coverage": []}, [("paragraph_coverage", "error", 1)]),
    "paragraphs null": ({"paragraph_coverage": None}, [("top_level_structure", "error", 1), ("paragraph_coverage", "error", 1)]),
    "odd status": ({"paragraph_coverage": [(1, "has_issue"), (2, "seen")]}, [("paragraph_coverage", "error", 1)]),
    "lost and new": ({"paragraph_coverage": [(1, "has_issue"), (3, "clean"), (None, "odd")]}, [("paragraph_coverage", "error", 1), ("paragraph_coverage", "warning", 1)]),
    "all clean": ({"paragraph_coverage": [(1, "clean"), (2, "clean")]}, [("iron_law_E", "error", 1)]),
    "fields": ({"issues": [GOOD_ISSUE, GOOD_ISSUE | {"issue": ""}, {"severity": "low"}, GOOD_ISSUE | {"paragraph_index": "0"}]}, [("issues", "error", 3)]),
    "unknown fields": ({"issues": [GOOD_ISSUE | {"comment": "", "mood": "x"}, GOOD_ISSUE | {"mood": "y", "chapter": "1"}]}, [("issues", "warning", 2)]),
    "values": ({"issues": [GOOD_ISSUE | {"severity": "high", "severity_justification": "because", "confidence": "sure"}]}, [("issues", "error", 1), ("issues", "error", 1), ("issues", "warning", 1)]),
    "no issues": ({"issues": []}, [("issues", "warning", 1), ("zero_issues", "error", 1)]),
    "one of 31": ({"expected_paragraphs": list(range(1, 32)), "paragraph_coverage": [(i, "has_issue") for i in range(1, 32)]}, [("single_issue_warning", "warning", 1)]),
    "two of 51": ({"issues": [GOOD_ISSUE] * 2, "expected_paragraphs": list(range(51)), "paragraph_coverage": [(i, "has_issue") for i in range(51)]}, [("low_issue_count_warning", "warning", 1)]),
    "three of 160": ({"issues": [GOOD_ISSUE] * 3, "expected_paragraphs": list(range(160)), "paragraph_coverage": [(i, "has_issue") for i in range(160)]}, [("low_issue_density_warning", "warning", 1)]),
    "no sheet": ({"expected_verdicts": None, "verdicts": None}, [("phase3_verdicts", "warning", 1)]),
    "nothing to judge": ({"expected_verdicts": [], "verdicts": [("z", "odd", "")]}, []),
    "verdicts": ({"verdicts": [("a", "maybe", LONG), ("c", "confirmed", "短")]}, [("phase3_verdicts", "error", 1)] * 3 + [("phase3_verdicts", "warning", 1)]),
    "all dismissed": ({"verdicts": [("a", "false_positive", LONG), ("b", "false_positive", LONG + "一")]}, [("phase3_verdicts_all_dismissed", "error", 1)]),
    "few confirmed": (
        {"verdicts": [(str(i), "confirmed" if i == 0 else "false_positive", LONG + "一二三四五六七八九十"[i % 10] * (1 + i // 10)) for i in range(30)], "expected_verdicts": [str(i) for i in range(30)]},
        [("phase3_verdicts_near_zero", "warning", 1)],
    ),
    "one explanation": ({"verdicts": [(x, "confirmed", LONG) for x in "abcd"], "expected_verdicts": list("abcd")}, [("verdict_copy_paste", "error", 1)]),
    "two of five": ({"verdicts": [(x, "confirmed", LONG + "一" * (x > "b")) for x in "abcde"], "expected_verdicts": list("abcde")}, [("verdict_low_uniqueness", "warning", 1)]),
}


@pytest.fixture(scope="module")
def reviews(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(n, *(GOOD | change).values()) for n, (change, _) in enumerate(CHANGES.values())], SCHEMA)


def test_every_rule_finds_what_breaks_it(reviews):  # noqa: ANN001, ANN201
    got: dict = {n: [] for n in range(len(CHANGES))}
    for r in constraints.findings(reviews).collect():
        got[r.doc_id].append((r.check, r.level, r.n))
    for n, (name, (_, want)) in enumerate(CHANGES.items()):
        assert sorted(got[n]) == sorted(want), name
    rules = {r.rule for r in constraints.findings(reviews).collect()}
    assert rules == set(constraints.RULES)


def test_a_review_passes_without_errors(reviews):  # noqa: ANN001, ANN201
    got = {r.doc_id: r for r in constraints.review_gate(reviews).collect()}
    for n, (name, (_, want)) in enumerate(CHANGES.items()):
        r = got[n]
        assert (r.errors, r.warnings, r.passed) == (sum(w[1] == "error" for w in want), sum(w[1] == "warning" for w in want), all(w[1] != "error" for w in want)), name
        assert r.failed == sorted({w[0] for w in want if w[1] == "error"})
    assert got[0].passed and got[list(CHANGES).index("one of 31")].re_review == []


def test_re_review_names_silent_groups(spark):  # noqa: ANN001, ANN201
    silent = {i: (True, 0 if i.startswith(("3.", "5.")) else 1) for i in constraints.CHECK_IDS}
    rows = [(1, *(GOOD | {"dimension_coverage": silent, "found_before": {}, "expected_paragraphs": list(range(1, 32)), "paragraph_coverage": [(i, "has_issue") for i in range(1, 32)]}).values()), (2, *(GOOD | {"dimension_coverage": silent, "found_before": None}).values())]
    got = {r.doc_id: r.re_review for r in constraints.review_gate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: ["三.数字符号单位", "五.格式与表格"], 2: []}


def test_constraints_from_a_table(spark, reviews):  # noqa: ANN001, ANN201
    rows = [(2, "issues", "error", "values_other_than", ["severity", "low"]), (1, "version", "warning", "version_other_than", ["9"]), (3, "any", "error", "no_issues", None)]
    mine = constraints.read_constraints(spark.createDataFrame(rows, "pos int, check string, level string, rule string, args array<string>"))
    assert [c.check for c in mine] == ["version", "issues", "any"]
    got = {r.doc_id: (r.errors, r.warnings) for r in constraints.review_gate(reviews, constraints=mine).collect()}
    assert got[0] == (0, 1) and got[list(CHANGES).index("no version")] == (0, 0) and got[list(CHANGES).index("values")] == (1, 1) and got[list(CHANGES).index("no issues")] == (1, 1)
    with pytest.raises(ValueError, match="no such constraint"):
        constraints.findings(reviews, constraints=[constraints.Constraint("x", "error", "unheard_of")])
    assert constraints.review_gate(reviews.limit(0)).count() == 0


def test_severities_rise_by_domain(spark):  # noqa: ANN001, ANN201
    docs = spark.createDataFrame([(1, "某医疗器械注册资料"), (2, "专利文献 药物临床"), (3, None), (4, "无规则")], "doc_id int, primary string")
    rules = {(r.doc_id, r.error_type) for r in severity.escalation_rules(docs).collect()}
    assert {d for d, e in rules if e == "medical_term_error"} == {1} and (2, "dose_error") in rules and (2, "claim_scope_error") not in rules and (3, "number_mismatch") in rules
    issues = [
        (1, 1, "4.1 术语", "on the Handpiece", "a handpiece here", "low"), (1, 2, "3.1", "the handpiece", "", "medium"), (1, 3, "3.1", "the tip", "", "low"), (2, 4, "4.1", "handpiece dose", "dose", "critical"),
        (2, 5, "4.1", "the handpiece", "x", "low"), (3, 6, "x", "valve", None, None), (4, 7, "x", "valve", None, "low"),
    ]
    terms = spark.createDataFrame([(1, "Handpiece"), (1, "tip"), (2, "dose"), (3, "valve"), (4, "valve")], "doc_id int, source string")
    some = severity.escalation_rules(docs).filter("doc_id <> 4")
    got = {r.issue_pos: (r.severity, r.reason, r.escalated) for r in severity.escalate(spark.createDataFrame(issues, "doc_id int, issue_pos int, check_item string, issue string, source_quote string, severity string"), terms, some).collect()}
    assert got == {1: ("medium", "medical_term_error", True), 2: ("critical", "handpiece", True), 3: ("low", None, False), 4: ("critical", "dose", False), 5: ("low", None, False), 6: ("critical", "valve", True), 7: ("low", None, False)}


def test_justifications_carry_severities(spark):  # noqa: ANN001, ANN201
    rows = [(1, "critical", "changes_meaning"), (2, "low", "changes_meaning"), (3, "critical", "unnatural_expression"), (4, "low", "unnatural_expression"), (5, "critical", "style_preference"), (6, "low", "because"), (7, "", "changes_meaning"), (8, "low", None)]
    d = spark.createDataFrame(rows, "issue_pos int, severity string, severity_justification string").selectExpr("*", "'1.1' AS check_item")
    got = {r.issue_pos: r.expected for r in severity.mismatches(d, ["issue_pos"]).collect()}
    assert got == {2: ["critical"], 4: ["medium"], 5: ["low"]}


def test_required_checks(spark):  # noqa: ANN001, ANN201
    docs = spark.createDataFrame([(1, "安全数据表"), (2, "x"), (3, None)], "doc_id int, primary string")
    counts = spark.createDataFrame([(1, "number_mismatches", 99), (1, "symbol_issues", 1), (2, "number_mismatches", 20), (2, "glossary_violations", 11), (2, "format_issues", 1), (3, "symbol_issues", 0), (9, "symbol_issues", 5)], "doc_id int, kind string, n int")
    got = sorted((r.doc_id, r.check_id, r.why) for r in context.required_checks(docs, counts).collect() if r.why != "domain")
    assert got == [(1, "3.3", "symbol_issues"), (2, "5.1", "format_issues")]
    assert context.required_checks(docs, counts).filter("why = 'domain'").count() == 5 + 4 + 4
