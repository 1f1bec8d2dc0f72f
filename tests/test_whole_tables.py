"""Queries over whole tables that have no SQL, against brute force."""

from __future__ import annotations

import re
from collections import defaultdict

import pytest

from lexiloom.functions import procedural
from lexiloom.operators import mechanical
from lexiloom.plans.queries import _PLANTED, QUERIES
from lexiloom.plans.tables import TERMS

TEXTS = {
    1: "First line 25 °C here. CAS 50-00-0\nsecond; ISO 13485 {\"a\": {\"b\": 1}} 5 hours 3 grams\n\nthe third of them\nfour\nfive the line\nsix",
    2: "Other text x with ± and\nlicense of the 5 meters {open\nthat is for\nder",
    3: "short", 4: "a。甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未。b" * 2, 5: "\n".join(f"{i} line of it" for i in range(1, 40)), 6: "",
}


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):  # noqa: ANN001, ANN201
    folder = str(tmp_path_factory.mktemp("whole"))
    rows = [(i, t, "en", "a", len(t)) for i, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder


def rows_of(spark, sf: str, name: str) -> list[tuple]:  # noqa: ANN001
    return sorted((tuple(r) for r in QUERIES[name](spark, sf).collect()), key=repr)


def lines_of(t: str) -> dict[int, str]:
    return {i: x.strip() for i, x in enumerate(t.split("\n"), 1) if x.strip()}


def test_sentences_quotes_json(spark, sf):  # noqa: ANN001, ANN201
    def first_json(t: str) -> str | None:
        depth, start = 0, t.find("{")
        for i in range(max(start, 0), len(t) if start >= 0 else 0):
            depth += (t[i] == "{") - (t[i] == "}")
            if depth == 0:
                return t[start : i + 1]
        return None

    def sentence(t: str, f: str) -> str:
        """Kinds of ends in their order; a place counts from the second character on."""
        f, i = f.strip(), t.find(f.strip())
        if not f or i < 0:
            return f
        before = [t[:i].rfind(e) for e in "。！？\n" if t[:i].rfind(e) > 0]
        after = [t.find(e, i + len(f)) for e in "。！？\n" if e in t[i + len(f) :]]
        return t[before[0] + 1 if before else i : after[0] + 1 if after else i + len(f)].strip()

    quotes = {i: t[10:30] for i, t in TEXTS.items()}
    assert rows_of(spark, sf, "f15_sentence_around_documents") == sorted(((i, sentence(t, quotes[i]) or quotes[i]) for i, t in TEXTS.items()), key=repr)
    fixed = {i: q if q.strip() in t and len(q.strip()) >= 15 else sentence(t, q) or q for (i, q), t in zip(quotes.items(), TEXTS.values(), strict=True)}
    assert rows_of(spark, sf, "f16_fix_quotes_documents") == sorted(fixed.items(), key=repr)
    assert rows_of(spark, sf, "f18_first_json_documents") == sorted(((i, first_json(t)) for i, t in TEXTS.items()), key=repr)


def test_symbols_and_units(spark, sf):  # noqa: ANN001, ANN201
    symbols, units = [], []
    for i, s in TEXTS.items():
        if (t := TEXTS.get(i + 1)) is None:
            continue
        s, t = s + _PLANTED[i % len(_PLANTED)], t + _PLANTED[(i * 3 + 1) % len(_PLANTED)]
        symbols += [(i, "symbol_missing", c) for c in mechanical.SYMBOLS if c in s and not any(x in t for x in (c, *mechanical.EQUIVALENTS.get(c, ())))]
        for kind, p in [("cas_missing", mechanical.CAS), *[("regulation_missing", p) for p in mechanical.STANDARDS]]:
            p = p.replace("(?U)", "")
            symbols += [(i, kind, m) for m in re.findall(p, s) if m not in re.findall(p, t)]
        if re.search(mechanical.LATIN_MARK_IN_CHINESE, t):
            symbols.append((i, "punctuation_mixed", None))
        for en, zh in mechanical.UNITS:
            if (m := re.search(rf"\d+(?:\.\d+)?\s*{en}s?\b", s, re.I)) and zh not in t:
                units.append((i, "full_unit_untranslated", m[0], zh))
    assert rows_of(spark, sf, "j09_check_symbols_pairs") == sorted(symbols, key=repr) and symbols
    assert rows_of(spark, sf, "j10_check_units_pairs") == sorted(units, key=repr) and len(units) >= 3


def test_places(spark, sf):  # noqa: ANN001, ANN201
    located, attached = [], []
    for i, t in TEXTS.items():
        lines, pages = lines_of(t), defaultdict(list)
        for k in lines:
            pages[(k - 1) // 3].append(k)
        dealt: dict[int, int] = defaultdict(int)
        for pos, value, *_ in TERMS:
            joined = {p: " ".join(lines[k] for k in ks) for p, ks in pages.items()}
            hits = [p for p in pages if value in joined[p]] or [p for p in pages if value.lower() in joined[p].lower()]
            page = min(hits, key=lambda p: (-len(pages[p]), p), default=None)
            located.append((i, pos, page, None if page is None else pages[page][dealt[page] % len(pages[page])]))
            if page is not None:
                dealt[page] += 1
        batches, load = defaultdict(list), defaultdict(int)
        for k in lines:
            batches[k // 10].append(k)
        for k in (k for k in lines if k % 7 == 1):
            at = k + 1_000_000 if k % 3 == 0 else k
            over = [b for b, ks in sorted(batches.items()) if ks[0] <= at <= ks[-1]]
            b = over[0] if over else min(batches, key=lambda b: (load[b], b))
            load[b] += 1
            attached.append((i, b, k))
    assert rows_of(spark, sf, "j13_locate_on_pages_lines") == sorted(located, key=repr)
    assert rows_of(spark, sf, "j22_attach_tables_lines") == sorted(attached, key=repr)


def test_quotes(spark, sf):  # noqa: ANN001, ANN201
    def squeeze(t: str) -> str:
        return re.sub(r"\s+", "", t)

    def way(t: str, q: str) -> str | None:
        for k in (15, 10, 8, 5):
            if len(q) >= k and q[:k] in t:
                return f"prefix{k}"
        chunk = max(re.findall("[一-鿿]{4,}", q), key=len, default="")
        return "whole" if q in t else "squeezed" if squeeze(q) in squeeze(t) else "chunk" if chunk and chunk in t else None

    want = []
    for i, t in TEXTS.items():
        lines, own, q = lines_of(t), i % 5, t[:40]
        near = [*range(own + 1, own + 6), *range(own - 1, own - 6, -1)]
        order = [("", own), *(("near ", k) for k in near), *(("document ", k) for k in sorted(lines))] if q else []
        want.append(next(((i, i, k, scope + w) for scope, k in order if k in lines and (w := way(lines[k], q))), (i, i, own, "bare")))
    assert rows_of(spark, sf, "j11_place_quotes_lines") == sorted(want, key=repr)
    assert len({w[3] for w in want}) >= 3


def test_quality_loop(spark, sf):  # noqa: ANN001, ANN201
    """Terms one after another by length, then what is left of them, then items that the mended text lacks."""
    ordered = sorted(((s, t) for _, s, t, _ in TERMS), key=lambda x: (-len(x[0]), x[0]))
    totals, warned = [], []
    for i in sorted(TEXTS)[:-1]:
        source, target = TEXTS[i], TEXTS[i + 1]
        if not target or target == source:
            continue
        held, applied = [(s, t) for s, t in ordered if s.lower() in source.lower()], 0
        for s, t in held:
            target, n = re.subn(re.escape(s), t, target, flags=re.I)
            applied += n > 0
        bad = [(s, t) for s, t in held if s.lower() in target.lower() or t not in target]
        items = procedural.critical_items_of(source)
        lost = [x for x in items if x["value"] not in target and not (x["category"] == "number_with_unit" and re.search(r"\d+(?:\.\d+)?", x["value"])[0] in target)]
        totals.append((i, applied, len(bad), len(items), len(lost)))
        warned += [(i, "术语未遵守", f'"{s}" 未翻译为 "{t}"') for s, t in bad]
        warned += [(i, f"关键项丢失({x['category']})", f'"{x["value"]}" 在译文中未找到') for x in lost if x["category"] in procedural.HIGH]
    assert any(t[1] for t in totals) and any(t[4] for t in totals)
    assert rows_of(spark, sf, "r13_quality_loop") == sorted(totals, key=repr)
    assert rows_of(spark, sf, "r13_quality_warnings") == sorted(warned, key=repr)


def test_similarity_is_that_of_matching_blocks():  # noqa: ANN201
    """Texts short and long, with characters so frequent that they begin no match."""
    from difflib import SequenceMatcher
    from random import Random

    r = Random(3)
    words = ["alpha", "beta", "gamma ray", "delta", "", "eps ilon", "zeta" * 20, "q", "é", "7%"]
    for n in [3] * 300 + [8] * 200 + [60] * 60 + [200] * 20:
        said = lambda: " ".join(r.choices(words, k=r.randint(0, n)))  # noqa: E731, B023
        a, b = said(), said()
        if r.random() < 0.5:
            b = b + a[r.randint(0, len(a)) :] + b[:9]
        want = SequenceMatcher(None, a, b).ratio()
        assert procedural.similarity(a, b) == want
        assert 2 * procedural.common_in_order(a, b) >= want * (len(a) + len(b)) - 1e-9
        for least, ties in ((0.0, True), (want, True), (want, False), (0.5, False), (-1.0, True)):
            assert procedural.ratio_that_wins(a, b, least, ties) == (want if want > least or ties and want == least else None)
    assert procedural.similarity("", "") == 1.0 and procedural.common_in_order("abcbdab", "bdcaba") == 4


def plain_page_map(pages: dict, paragraphs: list) -> dict:
    """Per page number the first and last paragraph of the first most similar window, and the similarity."""
    from difflib import SequenceMatcher

    w = max(2, len(paragraphs) // max(1, len(pages)))
    out, before = {}, (None, None, None)
    for page, text in sorted(pages.items()):
        if text.strip(" "):
            windows = [paragraphs[at : at + w] for at in range(0, len(paragraphs), max(1, w // 2))]
            scored = [(SequenceMatcher(None, text, " ".join(t for _, t in x)).ratio(), -k, x[0][0], x[-1][0]) for k, x in enumerate(windows)]
            best = max(scored, default=None)
            before = (best[2], best[3], best[0]) if best else before
        out[page] = before
    return out


@pytest.mark.parametrize("block", [256, 2])
def test_page_map_equals_comparing_all(spark, monkeypatch, block):  # noqa: ANN001, ANN201
    from random import Random

    from lexiloom.operators import placement

    monkeypatch.setattr(placement, "BLOCK", block)
    r = Random(block)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "q9", "ü", "the", "of"]
    pages, paras, want = [], [], {}
    for d in range(14):
        lines = [" ".join(r.choices(words, k=r.randint(1, 40 if d % 3 else 5))) for _ in range(r.randint(0 if d == 5 else 1, 25))]
        lines = [x for t in lines for x in [t] * r.choice([1, 1, 1, 3])]  # lines that repeat
        text = [lines[i : i + 3] for i in range(0, len(lines), 3)]
        mine = {k: " ".join(x if r.random() < 0.8 else x[::-1] for x in t) if r.random() < 0.85 else r.choice(["", "  ", "zz", "nothing like it"]) for k, t in enumerate(text, 1)}
        pages += [(d, k, t) for k, t in mine.items()]
        numbered = [(2 * i + 1, t) for i, t in enumerate(lines)]
        paras += [(d, i, t) for i, t in numbered]
        want |= {(d, k): v for k, v in plain_page_map(mine, numbered).items()}
    pages += [(99, 1, "no paragraphs at all")]
    want[99, 1] = (None, None, None)
    got = placement.page_map(spark.createDataFrame(pages, "doc_id int, page int, text string"), spark.createDataFrame(paras, "doc_id int, para_index int, text string"))
    assert {(r.doc_id, r.page): (r.first_index, r.last_index, r.similarity) for r in got.collect()} == want
    assert len({v[2] for v in want.values()}) > 10


def test_a_page_meets_few_windows(spark):  # noqa: ANN001, ANN201
    """Of a document of 300 different pages, hardly any window is compared besides the page's own."""
    from random import Random

    from lexiloom.operators import placement

    r = Random(1)
    lines = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(20)) for _ in range(900)]
    paras = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines, 1)], "doc_id int, para_index int, text string")
    pages = spark.createDataFrame([(1, k, " ".join(lines[3 * k : 3 * k + 3])) for k in range(300)], "doc_id int, page int, text string")
    placed, windows = placement._windows(pages, paras, "doc_id")
    seeds = placement._seeds(pages, placed, "doc_id").collect()
    assert len(seeds) == 300 and all(s.start == 3 * s.page for s in seeds)
    asked = spark.createDataFrame([(1, s.page, s.start, 1.0, t) for s, t in ((s, " ".join(lines[3 * s.page : 3 * s.page + 3])) for s in seeds)], "doc_id int, page int, seed int, least double, text string")
    asked = asked.withColumn("counts", procedural.character_counts("text"))
    met = placement.page_candidates(asked, windows.select("doc_id", "start", procedural.character_counts("combined").alias("counts")), "doc_id")
    assert windows.count() == 900 and met.count() == 300
    assert placement.page_map(pages, paras).filter("similarity < 1").count() == 0


def plain_way(t: str, q: str) -> str | None:
    squeeze = lambda x: re.sub(r"\s+", "", x)
    for k in (15, 10, 8, 5):
        if len(q) >= k and q[:k] in t:
            return f"prefix{k}"
    chunk = max(re.findall("[一-鿿]{4,}", q), key=len, default="")
    return "whole" if q in t else "squeezed" if squeeze(q) in squeeze(t) else "chunk" if chunk and chunk in t else None


def test_quotes_are_placed_in_every_way(spark):  # noqa: ANN001, ANN201
    from random import Random

    from lexiloom.operators import placement

    r = Random(8)
    words = ["alpha", "beta", "甲乙丙丁", "戊己庚辛壬", "x", "the of", "  ", "q r", "z" * 7]
    paras, quotes, want = [], [], []
    for d in range(12):
        lines = {i: " ".join(r.choices(words, k=r.randint(0, 9))) for i in r.sample(range(1, 40), 25)}
        paras += [(d, i, t) for i, t in lines.items()]
        for k in range(25):
            own, at = r.randint(0, 41), r.choice(sorted(lines))
            t = lines[at]
            begin = r.randint(0, len(t))
            q = r.choice([t[begin : begin + r.randint(0, 30)], t[begin : begin + 6] + " other", t.replace(" ", ""), "z z  z", "no such words", "     " + t[:6], "x", "", "甲乙丙丁 and", "a" + t])
            quotes.append((d, k, own, q))
            near = [*range(own + 1, own + 6), *range(own - 1, own - 6, -1)]
            order = [("", own), *(("near ", x) for x in near), *(("document ", x) for x in sorted(lines))] if q else []
            want.append(next(((d, k, x, scope + w) for scope, x in order if x in lines and (w := plain_way(lines[x], q))), (d, k, own, "bare")))
    got = placement.place_quotes(spark.createDataFrame(quotes, "doc_id int, quote_id int, paragraph_index int, quote string"), spark.createDataFrame(paras, "doc_id int, paragraph_index int, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {w[3].split()[0] for w in want} >= {"near", "document", "bare", "chunk", "squeezed", "prefix5"}


def test_quotes_meet_few_paragraphs(spark):  # noqa: ANN001, ANN201
    """Pairs grow with quotes: the same quotes in a document ten times as long meet as many paragraphs."""
    from lexiloom.operators import placement

    met = []
    for n in (300, 3000):
        texts = spark.createDataFrame([(1, i, f"{i:05d} paragraph of its own") for i in range(n)], "doc_id int, at int, text string")
        asked = spark.createDataFrame([(1, k, 0, f"{100 + k:05d} paragraph") for k in range(50)] + [(1, 90 + k, 0, f"absent {k}") for k in range(50)], "doc_id int, quote_id int, paragraph_index int, quote string")
        met.append((placement.near_paragraphs(asked, texts, "doc_id").count(), placement.possible_paragraphs(asked, texts, "doc_id").count()))
        placed = placement.place_quotes(asked, texts.withColumnRenamed("at", "paragraph_index"))
        assert placed.filter("strategy = 'document prefix15'").count() == 50 and placed.filter("strategy = 'bare'").count() == 50
    assert met[0] == met[1] == (500, 550)
