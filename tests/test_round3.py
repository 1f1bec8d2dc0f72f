"""Cases that the third review found, each against plain Python or hand-written rows."""

from __future__ import annotations

import random
from collections import Counter
from hashlib import md5

import corpus_pipeline
from lexiloom.llm import jaccard, packing, simhash
from lexiloom.operators import glossary, mechanical
from lexiloom.plans.queries import QUERIES


def test_decimal_near_a_page_range_counts_as_the_whole_number_next_to_it(spark):  # noqa: ANN001, ANN201
    values = ["35.92", "0.5", "0.49", "2000.4999", "2000.5", "99999999999999999999.1"]
    pairs = spark.createDataFrame([(v, f"see 120-125 for {v} of", "none") for v in values], "id string, source_text string, target_text string")
    found = mechanical.check_and_filter_numbers(pairs, ["id"]).filter("type = 'decimal_mismatch'").collect()
    assert sorted(r.source_value for r in found) == ["0.49", "2000.5", "99999999999999999999.1"]


def test_batches_of_the_whole_table_are_full_and_in_order(spark, tmp_path):  # noqa: ANN001, ANN201
    rng = random.Random(5)
    texts = {"".join(rng.choices("ab ", k=rng.randrange(1, 90))) for _ in range(9000)}
    rows = [(i, i % 3, "user", t) for i, t in enumerate([*sorted(texts), None])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7).write.parquet(f"{tmp_path}/conversations.parquet")
    got = [(r.n, r.t, r.batch_id) for r in QUERIES["t05_longest_first"](spark, str(tmp_path)).collect()]
    ordered = sorted(texts, key=lambda t: (-len(t), t))
    want = [(len(t), md5(t.encode()).hexdigest(), i // 30 + 1) for i, t in enumerate(ordered)] + [(None, None, len(ordered) // 30 + 1)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_search_gives_all_of_the_pages_asked_for(spark, tmp_path):  # noqa: ANN001, ANN201
    rows = [(i, "steel" if i % 2 else "tin", "Brand#1", "A" if i < 80 else "B") for i in range(1, 101)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = [(r.id, r.total) for r in QUERIES["p01_search_terms"](spark, str(tmp_path)).collect()]
    assert sorted(got, reverse=True) == [(i, 40) for i in range(79, 0, -2)][5:25]


def plain_merge(entries: list[tuple]) -> dict:
    """Per key the winner and its conflicts, an entry at a time."""
    out: dict = {}
    for e in sorted(entries):
        key, at = e[1].lower(), out.get(e[1].lower())
        if at is None:
            out[key] = [e, []]
        elif at[0][2] != e[2]:
            wins = e[5] < at[0][5]
            at[1].append((at[0][2], at[0][4], e[2], e[4], "use_new" if wins else "keep_existing"))
            if wins:
                at[0] = e
    return out


def test_merged_glossaries_equal_a_plain_loop(spark):  # noqa: ANN001, ANN201
    rng = random.Random(3)
    entries = [(i, rng.choice("aAbBcdE"), rng.choice("xyz"), "d", f"f{i % 5}", rng.randrange(6)) for i in range(400)]
    entries += [(400 + i, "long", t, "d", "f", p) for i, (t, p) in enumerate([("A", 5), ("A", 1), ("B", 4), ("A", 3), ("B", 2), ("B", 0), ("A", 1)])]
    terms = spark.createDataFrame(entries, "pos int, source string, target string, domain string, from_file string, priority int").repartition(5)
    got = {r.norm_key: [(r.target, r.from_file, r.priority), [tuple(c) for c in r.conflicts]] for r in glossary.merge_glossaries(terms).collect()}
    assert got == {k: [(w[2], w[4], w[5]), c] for k, (w, c) in plain_merge(entries).items()}
    assert len(got["long"][1]) == 4
    assert {r.norm_key: (r.target, r.from_file, r.priority) for r in glossary.merge_winners(terms).collect()} == {k: v[0] for k, v in got.items()}


def test_a_term_of_many_files_is_merged_without_a_row_of_all_its_entries(spark):  # noqa: ANN001, ANN201
    plan = glossary.merge_winners(spark.range(9).selectExpr("id pos", "'t' source", "string(id) target", "'d' domain", "'f' from_file", "1 priority"))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_packing_comes_from_the_linear_program_even_where_best_fit_meets_the_bound(monkeypatch):  # noqa: ANN001, ANN201
    counts, seen = {x: 1 + x % 7 for x in range(20, 2000, 9)}, []
    least = -(-sum(x * n for x, n in counts.items()) // packing.SEQ_LEN)
    alone, plain = sum(packing.best_fit(counts, packing.SEQ_LEN).values()), packing.best_fit
    assert alone <= 1.01 * least
    monkeypatch.setattr(packing, "best_fit", lambda left, capacity: seen.append(sum(x * n for x, n in left.items())) or plain(left, capacity))
    plan, used = packing.pack_plan(counts), Counter()
    for p, n in plan:
        assert sum(p) <= packing.SEQ_LEN
        used.update({x: k * n for x, k in Counter(p).items()})
    assert used == Counter(counts) and seen and max(seen) < sum(x * n for x, n in counts.items())
    assert sum(n for _, n in plan) <= 1.01 * least + 1


def test_pipeline_links_near_fingerprints_whatever_the_bands_say(spark, monkeypatch):  # noqa: ANN001, ANN201
    rng = random.Random(2)
    texts = {k: [f"w{rng.randrange(3000)}" for _ in range(1500)] for k in range(4)}
    near = {10 + k: [*w[:-1], "changed"] for k, w in texts.items()}
    docs = spark.createDataFrame([(k, " ".join(w), "en", "a", 1) for k, w in (texts | near).items()], "doc_id long, text string, lang string, source string, n_chars long")
    sets = {k: jaccard.shingle_set(" ".join(w)) for k, w in (texts | near).items()}
    apart = {k: (simhash.majority_bits(sets[k]) ^ simhash.majority_bits(sets[10 + k])).bit_count() for k in texts}
    assert max(apart.values()) <= jaccard.RADIUS
    assert all(set(jaccard.simhash_keys(sets[k])) & set(jaccard.simhash_keys(sets[10 + k])) for k in texts)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted(texts)
    monkeypatch.setattr(jaccard, "band_keys", lambda s: [])
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted(texts)
