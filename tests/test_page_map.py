"""Pages are held against few windows, each pair once."""

from difflib import SequenceMatcher
from random import Random

import numpy as np
import pytest
from test_whole_tables import plain_page_map

from lexiloom.functions import procedural
from lexiloom.operators import placement


def _texts(r: Random) -> tuple[str, str]:
    words = ["".join(r.choices("abcdexyz Qü", k=r.randint(1, 6))) for _ in range(8)]
    some = lambda: " ".join(r.choices(words, k=r.randint(0, 150)))
    a = some()
    return a, r.choice([some(), a[: r.randint(0, len(a))], a[r.randint(0, len(a)) :], a + some(), a[10:60], some() + a])


@pytest.mark.parametrize("large", [1, 1 << 16])
def test_ratio_is_exact_whatever_it_has_to_beat(monkeypatch, large):  # noqa: ANN001, ANN201
    monkeypatch.setattr(procedural, "LARGE_PART", large)
    r = Random(large)
    for _ in range(300):
        a, b = _texts(r)
        want = SequenceMatcher(None, a, b).ratio()
        assert procedural.similarity(a, b) == want
        for least in (-1.0, 0.0, want, r.random()):
            for ties in (True, False):
                assert procedural.ratio_that_wins(a, b, least, ties) == (want if want > least or ties and want == least else None)


def test_comparing_ends_when_too_little_is_left() -> None:
    r = Random(4)
    a, b = ("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=2000)) for _ in range(2))
    full = procedural.matched_characters(a, b)
    assert procedural.matched_characters(a, b, full) == full
    assert procedural.matched_characters(a, b, full + 1) is None


def test_a_page_is_compared_with_its_own_windows_first(monkeypatch):  # noqa: ANN001, ANN201
    """Of windows of two lines, those of a page of three are told from all others without a full comparison."""
    done = []
    real = procedural.matched_characters
    monkeypatch.setattr(procedural, "matched_characters", lambda *x: done.append(real(*x)) or done[-1])
    r = Random(2)
    lines = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz  ", k=180)) for _ in range(120)]
    windows = [" ".join(lines[i : i + 2]) for i in range(120)]
    counts = np.array([np.frombuffer(procedural.counts_of(w), np.uint32) for w in windows]).astype(np.int64)
    begun = {}
    for k in range(40):
        at, ratio = procedural.best_window(" ".join(lines[3 * k : 3 * k + 3]), counts, windows, np.arange(120), begun)
        assert at == 3 * k and ratio == 2 * 361 / (361 + 542)
    assert sum(x is not None for x in done) <= 40


@pytest.mark.parametrize("blocks", [0, 4])
def test_page_map_in_rows_and_in_blocks(spark, monkeypatch, blocks):  # noqa: ANN001, ANN201
    monkeypatch.setattr(placement, "ROW_BLOCKS", blocks)
    r = Random(7)
    pages, paras, want = [], [], {}
    for d in range(8):
        lines = [_texts(r)[0].strip() or "x" for _ in range(r.randint(1, 12))]
        mine = {k: r.choice(["", " ".join(lines[3 * k : 3 * k + 3])] + [" ".join(lines[3 * k : 3 * k + 3])[::-1]] * 2) for k in range((len(lines) + 2) // 3)}
        pages += [(d, k, t) for k, t in mine.items()]
        paras += [(d, i, t) for i, t in enumerate(lines)]
        want |= {(d, k): v for k, v in plain_page_map(mine, list(enumerate(lines))).items()}
    found = placement.page_map(spark.createDataFrame(pages, "doc_id int, page int, text string"), spark.createDataFrame(paras, "doc_id int, para_index int, text string"))
    assert {(x.doc_id, x.page): (x.first_index, x.last_index, x.similarity) for x in found.collect()} == want


def test_pairs_are_not_compared_twice(spark):  # noqa: ANN001, ANN201
    """The comparison of pairs stands in the plan once, beside that of the seeds, and nothing drops rows by it."""
    pages = spark.createDataFrame([(1, 1, "alpha beta")], "doc_id int, page int, text string")
    paras = spark.createDataFrame([(1, 1, "alpha beta")], "doc_id int, para_index int, text string")
    plan = placement.page_map(pages, paras)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("EvalPython [ratio_above" in x for x in plan.splitlines()) == 2
