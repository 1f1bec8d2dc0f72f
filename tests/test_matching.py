"""Words, phrases, substrings and patterns in texts, against plain loops."""

from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.functions import procedural
from lexiloom.operators import context, glossary
from lexiloom.operators.wordindex import phrase_counts, phrases, word_index

WORDS = ["a", "b", "ab", "data", "the", "of", "ré", "x1", "中文"]
GAPS = [" ", "  ", ", ", "-", " (", "+", "\n", "± "]


def texts_of(rng: random.Random, n: int, most: int = 14) -> list[str]:
    return ["".join(rng.choice(["", *GAPS]) if i == 0 else rng.choice(WORDS) + rng.choice(GAPS) for i in range(rng.randint(0, most))) + rng.choice(["", "a", "the."]) for _ in range(n)]


def bounded(term: str, text: str) -> int:
    """Occurrences between word boundaries; of signs alone, anywhere."""
    signs = not re.search(r"\w", term)
    return len(re.findall(re.escape(term.lower()) if signs else rf"\b{re.escape(term.lower())}\b", text.lower()))


TERMS = ["a", "A b", "a a", "a b a", "the", "of the", "data of the", "data-the", "the data of the", "C++", "a+", "+a", " a", "(ab", "±", "", "  ", "a  b", "ré", "中文", "ab ab ab", "x1, a", "+a b a", "a b a+", "-the of data(", "the of data the of", "zzz", "the, the", "a b a b"]


@pytest.fixture(scope="module")
def said():  # noqa: ANN201
    rng = random.Random(11)
    return [*texts_of(rng, 250), None, "", "a a a a a", "a b a b a b a", "x+a b a+b", "a-the of data (the of data the of the", "a+a b a", "the data of the data of the", "x+a+b", "a  b", "ab ab ab ab", "5 ± 3", "AB THE OF THE"]


def test_words_and_phrases_equal_patterns(spark, said):  # noqa: ANN001, ANN201
    texts = spark.createDataFrame(list(enumerate(said)), "doc_id int, text string").repartition(5)
    terms = spark.createDataFrame(list(enumerate(TERMS)), "pos int, source string")
    want = {(i, k): n for i, t in enumerate(said) if t for k, s in enumerate(TERMS) if s.strip() and (n := bounded(s, t))}
    got = glossary.word_matches(texts, terms, ["doc_id"])
    assert got.columns == ["doc_id", "pos", "source"]
    assert sorted((r.doc_id, r.pos) for r in got.collect()) == sorted(want)
    counts = phrase_counts(word_index(texts, ["doc_id"]), phrases(terms), ["doc_id"])
    assert {(r.doc_id, r.pos): r["count"] for r in counts.collect()} == {k: n for k, n in want.items() if re.search(r"\w", TERMS[k[1]])}
    assert len(want) > 600 and any(TERMS[k] == "a b a" and n > 1 for (_, k), n in want.items())


def test_index_has_every_word_once(spark, said):  # noqa: ANN001, ANN201
    texts = spark.createDataFrame(list(enumerate(said)), "doc_id int, text string")
    want = []
    for i, t in enumerate(said):
        parts = re.split(r"(\w+)", (t or "").lower())
        words, gaps = parts[1::2], parts[2:-1:2]
        want += [(i, k, gaps[k - 1] if k else None, w, gaps[k] if k < len(gaps) else None, words[k + 1] if k + 1 < len(words) else None, gaps[k + 1] if k + 1 < len(gaps) else None) for k, w in enumerate(words)]
    assert sorted(map(tuple, word_index(texts, ["doc_id"]).collect()), key=repr) == sorted(want, key=repr)


def test_glossaries_of_odd_rows(spark):  # noqa: ANN001, ANN201
    texts = spark.createDataFrame([(1, "the ± of ±3"), (2, None), (3, "")], "doc_id int, text string")
    pairs = spark.createDataFrame([(1, "the ± of ±3", "xx"), (2, None, None), (3, "the", None)], "doc_id int, source_text string, target_text string")
    for rows in ([], [(1, "", "x", "通用")], [(1, None, "x", "通用")], [(1, "±", "x", None)], [(1, "  ", "x", "通用"), (2, "the", "y", "通用")]):
        terms = spark.createDataFrame(rows, "pos int, source string, target string, domain string")
        n = sum(1 for r in rows if (r[1] or "").strip())
        assert glossary.word_matches(texts, terms, ["doc_id"]).count() == n
        assert glossary.check_glossary(pairs, terms, ["doc_id"]).count() == sum(1 for r in rows if (r[1] or "").strip() and r[2] not in "xx")
        assert glossary.substring_matches(texts, terms, ["doc_id"]).count() >= n


def test_client_terms_cover_general_ones(spark):  # noqa: ANN001, ANN201
    rng = random.Random(5)
    pairs = [(i, t, u) for i, (t, u) in enumerate(zip(texts_of(rng, 80), texts_of(rng, 80), strict=True))]
    general = [(s, s + "-" + str(k), "d" if k % 2 else "通用") for k, s in enumerate(["a", "of the", "data", "the", "ab"])] + [("ab", "a", "d"), ("中文", "a", "other")]
    client = [("The", "b"), ("Of  the", "data"), ("a", "ré")]
    want = []
    for i, t, u in pairs:
        mine = [(s, x) for s, x in client if bounded(s, t)]
        covered = {" ".join(s.lower().split()) for s, _ in mine}
        found = [("client_glossary_violation", s, x, "", "critical") for s, x in mine]
        found += [("glossary_violation", s, x, d, "low" if len(s) <= 3 else "critical") for s, x, d in general if d in ("d", "通用") and bounded(s, t) and s not in covered]
        want += [(i, *f) for f in found if f[2].lower() not in u.lower()]
    d = spark.createDataFrame(pairs, "doc_id int, source_text string, target_text string")
    g = spark.createDataFrame(general, "source string, target string, domain string")
    c = spark.createDataFrame(client, "source string, target string")
    got = glossary.check_glossary(d, g, ["doc_id"], c, "d")
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50


def test_key_terms_by_every_signal(spark):  # noqa: ANN001, ANN201
    """Frequent terms, and rare ones saved by a client, an identifier, a heading, the beginning or a table."""
    lines = ["Skin tightening study", "A randomised trial against sham with one endpoint", "second part", "the hand piece and the hand piece, then hand-piece", "cooling and cooling", "IPE is named once", "H319 | CVE-2031-12345 | hand piece", "nothing of note: sham gel"]
    p = spark.createDataFrame([(1, i, t, 1 if i == 1 else None, "|" in t) for i, t in enumerate(lines, 1)], "doc_id int, para_index int, text string, heading_level int, is_table_cell boolean")
    said = ["hand piece", "tightening", "sham", "endpoint", "IPE", "H319", "CVE-2031-12345", "cooling", "CAS 7732-18-5", "gel", "of note"]
    t = spark.createDataFrame([(i, s, f"{s}译", "d") for i, s in enumerate(said)], "pos int, source string, target string, domain string")
    target = spark.createDataFrame([(1, "hand piece译 sham译")], "doc_id int, target_text string")
    client = spark.createDataFrame([("ipe",), ("Hand Piece",)], "source string")
    got = {r.source: (r.channel, r["count"], r.importance_reason, r.translation_status) for r in context.key_terms(p, target, t, client).collect()}
    assert got == {
        "hand piece": ("frequent", 3, "client_mandated|table_term", "present"), "IPE": ("rare", 1, "client_mandated|translation_missing", "missing"), "H319": ("rare", 1, "domain_critical|table_term|translation_missing", "missing"),
        "CVE-2031-12345": ("rare", 1, "domain_critical|table_term|translation_missing", "missing"), "tightening": ("rare", 1, "heading_term|abstract_term|translation_missing", "missing"),
        "sham": ("rare", 2, "abstract_term", "present"), "endpoint": ("rare", 1, "abstract_term|translation_missing", "missing"),
    }
    order = [r.source for r in context.key_terms(p, target, t, client).filter("channel = 'rare'").orderBy("nth").collect()]
    assert order[0] == "IPE" and set(order[1:3]) == {"H319", "CVE-2031-12345"} and order[3] == "sham"
    counts = {r.source: (r["count"], r.paragraphs) for r in context.term_counts(p, t, ["doc_id"]).collect()}
    assert counts["hand piece"] == (3, 2) and counts["cooling"] == (2, 1) and "CAS 7732-18-5" not in counts


# --- substrings and patterns -----------------------------------------------------------------------------------------


def no_nested_loop(df) -> None:  # noqa: ANN001
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


SAID = [("data of the d", False), ("DATA of", True), ("data of", True), ("the", False), ("The", True), ("THE", True), ("he", False), ("hers", False), ("her", None), ("", False), ("οδοσ", False), ("ΟΔΟΣ", True), ("i̇s", False), ("25 °c", False), ("25 °C", True), ("the", False), ("absent", True), ("😀", False), ("a😀b", True), ("e", None), ("of the d", False)]
HELD = [None, "", "THE İstanbul ΟΔΟΣ of ΟΔΟΣx", "her hers she", "at 25 °C, or 25 °c", "x a😀b The", "data of the data", "h e r", "ab\nthe\n"]


@pytest.mark.parametrize("few", [64, 3])
def test_substrings_by_grams_and_one_by_one(spark, monkeypatch, few):  # noqa: ANN001, ANN201
    monkeypatch.setattr(glossary, "FEW_TERMS", few)
    texts = spark.createDataFrame(list(enumerate([*HELD, *texts_of(random.Random(2), 60)])), "doc_id int, text string")
    terms = spark.createDataFrame([(i, s, c) for i, (s, c) in enumerate(SAID)], "pos int, source string, case_sensitive boolean")
    low = {r.doc_id: r.low for r in texts.selectExpr("doc_id", "lower(text) low").collect()}
    want = [(d, i, s, c) for d, t in texts.collect() if t for i, (s, c) in enumerate(SAID) if s and (s in t if c else spark_lower(spark, s) in low[d])]
    got = glossary.substring_matches(texts, terms, ["doc_id"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and got.columns == ["doc_id", "pos", "source", "case_sensitive"]
    no_nested_loop(got)


LOWER: dict[str, str] = {}


def spark_lower(spark, s: str) -> str:  # noqa: ANN001
    if s not in LOWER:
        LOWER[s] = spark.createDataFrame([(s,)], "s string").selectExpr("lower(s)").first()[0]
    return LOWER[s]


PATTERNS = [r"the", r"dat(a|e)", r"\bof\b", r"\d+", r"25 °?C", r"h\.e", r"a|b", r"x[12]{1,2}", r"the\s+data", r"(?:zz)?ré", r"of+ ", r"中.", r"da?ta", r"\Qa+\E"]


@pytest.mark.parametrize("few", [64, 2])
def test_patterns_by_their_literals_and_one_by_one(spark, monkeypatch, few):  # noqa: ANN001, ANN201
    monkeypatch.setattr(glossary, "FEW_TERMS", few)
    said = [*HELD, *texts_of(random.Random(4), 60)]
    texts = spark.createDataFrame(list(enumerate(said)), "doc_id int, text string")
    rows = [(i, s, i % 3 == 0, True, "通用") for i, s in enumerate(PATTERNS)] + [(50 + i, s, False, False, "x") for i, s in enumerate(["the", "of", "", "+"])]
    terms = spark.createDataFrame(rows, "pos int, source string, case_sensitive boolean, is_regex boolean, domain string")
    plain = lambda p: re.sub(r"\\Q(.*?)\\E", lambda m: re.escape(m[1]), p)
    want = []
    for d, t in enumerate(said):
        held = [(i, s) for i, s, exact, regex, _ in rows if s and t and (re.search(plain(s), t, 0 if exact else re.I | re.A) if regex else s in t.lower())]
        want += [(d, i) for i, _ in held]
    got = glossary.match_glossary(texts, terms, ["doc_id"])
    assert sorted((r.doc_id, r.pos) for r in got.collect()) == sorted(want)
    no_nested_loop(got)
    top = glossary.match_glossary(texts, terms, ["doc_id"], most=2)
    assert top.groupBy("doc_id").count().filter("count > 2").count() == 0 and top.count() > 60


PIECES = ["a", "bc", ".", "\\d", "\\.", "x*", "y?", "z+", "(ab)", "(a|b)?", "[a-c]", "[^]x]", "\\b", "w{0,2}", "\\w+", "(?:q(r)s)", "-"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=6), st.text("abcxyzwqrs.-1 ", max_size=14))
def test_literals_are_in_every_match(pieces, text):  # noqa: ANN001, ANN201
    pattern = "".join(pieces)
    if m := re.search(pattern, text):
        assert procedural.literal_of(pattern) in m[0]


def test_literals():  # noqa: ANN201
    got = {p: procedural.literal_of(p) for p in (r"abc", r"ab?cde", r"a|bcd", r"(abc)de", r"[abc]+xyz\d", r"\Qa.b\E+", r"\p{L}abc", r"\x41bc", r"ab{2}cd", r"a\.b", r"(?x) a b", r"", r"(un[)]|re)do")}
    assert got == {r"abc": "abc", r"ab?cde": "cde", r"a|bcd": "", r"(abc)de": "de", r"[abc]+xyz\d": "xyz", r"\Qa.b\E+": "a.b", r"\p{L}abc": "abc", r"\x41bc": "bc", r"ab{2}cd": "cd", r"a\.b": "a.b", r"(?x) a b": "", r"": "", r"(un[)]|re)do": "do"}
