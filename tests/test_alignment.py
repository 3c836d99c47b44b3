"""Candidates, rankings, metrics, populations and tests on small literal inputs."""

from __future__ import annotations

import math
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from equiweave.operators import candidates as C
from equiweave.operators import metrics as M
from equiweave.operators import population as P
from equiweave.operators import ranking as R
from equiweave.operators import reports as Rep
from equiweave.operators import stats as S
from equiweave.plans import registry
from equiweave.plans import tables as T


def table(spark, ddl, *rows):
    return spark.createDataFrame(list(rows), ddl)


def lists(spark, *rows):
    return table(spark, "condition string, pair string, s string, t string, score double, rank int", *[("c", "p", *r) for r in rows])


def refs(spark, *rows):
    return table(spark, "condition string, pair string, s string, t string", *[("c", "p", *r) for r in rows])


LABELS = "uri string, label string"


def test_ties_go_to_the_smaller_uri(spark):
    s, t = table(spark, LABELS, ("s", "aaaa")), table(spark, LABELS, ("t2", "aaaa"), ("t1", "aaaa"), ("t3", "aaaa"))
    got = C.candidates(s, t, n=2, metric="jaccard", top_k=2).orderBy("rank").collect()
    assert [(r.t, r.rank, r.score) for r in got] == [("t1", 1, 1.0), ("t2", 2, 1.0)]


@pytest.mark.parametrize("metric", ["cosine", "jaccard"])
def test_indexed_join_equals_all_pairs(spark, metric):
    rnd = random.Random(3)
    def name():
        return " ".join("".join(rnd.choice("abcé") for _ in range(rnd.randrange(1, 6))) for _ in range(2))

    s = table(spark, LABELS, *[(f"s{i}", name()) for i in range(12)], ("s99", "  "), ("s98", "zzzz"))
    t = table(spark, LABELS, *[(f"t{i}", name()) for i in range(30)], ("t99", ""))
    def plain(df):
        return sorted((r.s, r.t, round(r.score, 9), r.rank) for r in df.collect())

    small = [x.withColumn("label", C.normalize(F.col("label"))) for x in (s, t)]
    assert plain(C.candidates(s, t, metric=metric, top_k=7, padded=True)) == plain(C.all_pairs(*small, metric=metric, top_k=7))


def test_padded_query_ranks_all_targets_and_pads(spark, tmp_path):
    names = {10: "zzqq", 20: "", 30: "green apple", 40: "apple pie 5", 50: "xylo"}
    names |= {51: "xylophone", 52: "a xyl"} | {k: f"apple pie {k}" if k > 60 else f"green {k}" if k % 10 < 4 else f"{k}" for k in range(1, 100) if k % 10 and k not in (51, 52)}
    spark.createDataFrame(list(names.items()), "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(tuple(r) for r in registry.QUERIES["ngram_topk_padded_all"](spark, str(tmp_path)).select("s", "t", "score", "rank").collect())
    want = sorted((r.s, r.t, round(r.score, 9), r.rank) for r in C.all_pairs(*T.parts(spark, str(tmp_path))).collect())
    assert got == want and len(got) == 5 * C.TOP_K
    padding = [sum(s == f"part/{k}" and score == 0 for s, _, score, _ in got) for k in (10, 50, 40)]
    assert padding == [C.TOP_K, C.TOP_K - 2, 0]


def test_bad_parameters_are_refused(spark):
    s = table(spark, LABELS, ("s", "a"))
    with pytest.raises(ValueError):
        C.candidates(s, s, top_k=0)
    with pytest.raises(ValueError):
        C.candidates(s, s, metric="dice")


def test_one_to_many_metrics(spark):
    ranked = lists(spark, ("a", "x", 0.9, 1), ("a", "z", 0.8, 2), ("a", "n1", 0.1, 3), ("b", "n2", 0.9, 1), ("b", "y", 0.5, 2))
    gold = refs(spark, ("a", "x"), ("a", "z"), ("b", "y"))
    assert M.mrr(ranked, gold).first().mrr == 0.75
    assert M.hits_at(ranked, gold, 1).first().hits_at_1 == 0.5
    assert math.isclose(M.recall_at(ranked, gold, 1).first().recall_at_1, 1 / 3)


def test_missing_lists_and_repeated_references(spark):
    ranked, gold = lists(spark, ("a", "x", 0.9, 1)), refs(spark, ("a", "x"), ("a", "x"), ("q", "y"))
    assert M.mrr(ranked, gold).first().mrr == 0.5
    assert math.isclose(M.recall_at(ranked, gold, 1).first().recall_at_1, 2 / 3)
    best = {r.s: r for r in R.gold_ranks(ranked, gold).collect()}
    assert (best["q"].ranked, best["q"].best_gold_rank, best["q"].gold_ranks) == (False, None, [None])


def test_threshold_takes_the_lower_median_of_ties(spark):
    ranked, gold = lists(spark, ("a", "x", 0.5, 1), ("b", "n", 0.2, 1)), refs(spark, ("a", "x"), ("b", "y"))
    got = M.tune_threshold(ranked, gold).first()
    tied = [k / 100 for k in range(21, 51)]
    assert got.threshold == tied[(len(tied) + 1) // 2 - 1] and math.isclose(got.f1, 2 / 3)
    with pytest.raises(ValueError):
        M.tune_threshold(ranked, gold, [])


def test_all_metrics_of_an_empty_list(spark):
    thresholds = table(spark, "condition string, pair string, threshold double", ("c", "p", 0.5))
    got = M.all_metrics(lists(spark).limit(0), refs(spark, ("a", "x")), thresholds).first()
    assert (got.mrr, got.recall_at_10, got.threshold) == (0.0, 0.0, 0.5)


def test_population_precedence_and_share(spark):
    sources = table(spark, "pair string, s string", *[("p", f"http://example.org/u{i}") for i in range(5000)], ("p", "k"))
    rows = [("p", "val", f"v{i}", "x") for i in range(20)] + [("p", "test", f"t{i}", "x") for i in range(80)] + [("p", "test", "v0", "y"), ("p", "train", "k", "z"), ("p", "train", "v1", "w")]
    got = {r.s: r.slice for r in P.populations(sources, table(spark, "pair string, split string, s string, t string", *rows)).collect()}
    assert got["v0"] == "test" and got["v1"] == "val" and got["k"] == "known"
    drawn = [v for k, v in got.items() if k.startswith("http")]
    assert abs(drawn.count("unmatched_val") / len(drawn) - 19 / 100) < 0.03


def test_known_pairs_go_before_the_first_target_is_judged(spark):
    ranked = lists(spark, ("a", "k", 0.9, 1), ("a", "x", 0.8, 2), ("b", "n", 0.7, 1))
    gold, known = refs(spark, ("z", "x")), table(spark, "pair string, s string, t string", ("p", "a", "k"))
    pairs = table(spark, "pair string, reference_complete boolean", ("p", False))
    assert [(r.s, r.t, r.rank) for r in P.judgeable(ranked, gold, known, pairs).collect()] == [("a", "x", 1)]


def test_splits_group_sources(spark):
    rows = table(spark, "ord long, s string, t string", *[(i, f"s{i % 10}", f"t{i}") for i in range(30)])
    for exact in (True, False):
        got = P.split_by_source(rows, exact=exact).collect()
        by = {}
        for r in got:
            by.setdefault(r.s, set()).add(r.split)
        assert all(len(v) == 1 for v in by.values()) and sum(v == {"val"} for v in by.values()) == 2
    parts = [r.split for r in P.split_by_row(rows).collect()]
    assert (parts.count("train"), parts.count("val"), parts.count("test")) == (24, 3, 3)


def test_similarity_blocks_equal_numpy(spark):
    r = np.random.default_rng(2)
    a, b = r.normal(size=(30, 8)), r.normal(size=(50, 8))
    left, right = table(spark, "s string, vec array<double>", *[(f"s{i}", x.tolist()) for i, x in enumerate(a)]), table(spark, "t string, vec array<double>", *[(f"t{i:02}", x.tolist()) for i, x in enumerate(b)])
    got = {(x.s, x.rank): x.t for x in R.similarity_matrix(left, right, 5, block=16).collect()}
    scores = np.round(a @ b.T, 9)
    for i in range(30):
        want = sorted(range(50), key=lambda j: (-scores[i, j], f"t{j:02}"))[:5]
        assert [got[f"s{i}", k + 1] for k in range(5)] == [f"t{j:02}" for j in want]


def test_f1_units(spark):
    ranked, gold = lists(spark, ("s", "a", 0.9, 1)), refs(spark, ("s", "a"), ("s", "b"))
    units = S.unit_values(R.gold_ranks(ranked, gold), R.predictions(ranked, gold, F.lit(0.5)), gold).collect()
    got = {u.metric: (u.c1, u.c2, u.c3) for u in units}
    assert got["f1"] == (1, 0, 1) and got["mrr"] == (1, 1, 0)


def test_signed_rank_enumerates_flips(spark):
    base, shift = [0.3, 0.4, 0.5, 0.2, 0.6, 0.1], [0.01, 0.02, -0.03, 0.04, 0.05, 0.06]
    rows = [("x", f"u{i}", a, a + d) for i, (a, d) in enumerate(zip(base, shift, strict=True))]
    got = S.signed_rank(table(spark, "comparison string, unit string, a double, b double", *rows)).first()
    ranks = [1, 2, 3, 4, 5, 6]
    observed = min(3, 21 - 3)
    p = np.mean([min(w := sum(r for r, f in zip(ranks, flips, strict=True) if f), 21 - w) <= observed for flips in product([0, 1], repeat=6)])
    assert math.isclose(got.p_value, p) and (got.w_plus, got.w_minus) == (18.0, 3.0) and got.min_attainable_p == 2 / 64


def test_signed_rank_needs_five_units_and_differences(spark):
    ddl = "comparison string, unit string, a double, b double"
    few = S.signed_rank(table(spark, ddl, *[("x", str(i), 0.1, 0.2) for i in range(4)])).first()
    same = S.signed_rank(table(spark, ddl, *[("x", str(i), 0.1, 0.1) for i in range(6)])).first()
    assert few.p_value is None and same.p_value == 1.0 and same.n_nonzero == 0


def test_holm_families(spark):
    tests = table(spark, "f string, o int, p_value double", ("a", 0, 0.01), ("a", 1, 0.04), ("a", 2, 0.03), ("a", 3, None), ("b", 0, 0.2))
    def got(df):
        return {(r.f, r.o): r.p_adjusted for r in df.collect()}

    plain = got(S.holm(tests, ["f"], "o"))
    assert [round(plain["a", k], 9) for k in (0, 2, 1)] == [0.03, 0.06, 0.06] and plain["a", 3] is None and plain["b", 0] == 0.2
    assert round(got(S.holm(tests, ["f"], "o", complete=True))["a", 0], 9) == 0.04
    strict = got(S.holm_or_nothing(tests, ["f"], "o"))
    assert strict["a", 0] is None and strict["b", 0] == 0.2


def test_paired_test_of_equal_sides_and_repeats(spark):
    ddl = "comparison string, dataset string, metric string, pair string, unit string, a1 double, a2 double, a3 double, b1 double, b2 double, b3 double"
    rows = [("x", "d", "mrr", f"p{i % 2}", f"u{i}", 1.0 if i % 3 else 0.5, 1.0, 0.0, 1.0, 1.0, 0.0) for i in range(40)]
    a = S.paired_tests(table(spark, ddl, *rows), replicates=300).first()
    b = S.paired_tests(table(spark, ddl, *reversed(rows)), replicates=300).first()
    assert a == b and a.ci_low <= a.delta <= a.ci_high and 0 < a.p_value < 0.05
    same = S.paired_tests(table(spark, ddl, *[(*r[:5], 1.0, 1.0, 0.0, 1.0, 1.0, 0.0) for r in rows]), replicates=100).first()
    assert same.delta == 0 and same.p_value == 1.0


def test_reports(spark, tmp_path):
    rows = table(spark, "condition_id string, dataset_id string, pair_name string, f1 double, mrr double, hits_at_1 double", ("a", "D1", "p", 0.12345, 0.5, 0.5), ("a", "D1", "q", 0.12345, 0.5, None), ("b", "D1", "p", 0.1, 0.5, 0.4))
    assert {r.condition_id: r.D1 for r in Rep.breakdown(rows, "f1", ["D1"]).collect()} == {"a": 0.1234, "b": 0.1}
    assert {r.condition_id: r.D1 for r in Rep.breakdown(rows, "hits_at_1", ["D1"]).collect()} == {"a": None, "b": 0.4}
    with pytest.raises(ValueError):
        Rep.breakdown(rows, "speed", ["D1"])
    text = Rep.report([("One", Rep.breakdown(rows, "f1", ["D1"]).orderBy("condition_id"))], str(tmp_path / "r.md"))
    assert text == (tmp_path / "r.md").read_text() and "| a | 0.1234 |" in text
    assert Rep.latex(Rep.breakdown(rows, "f1", ["D1"]).orderBy("condition_id"), {"D1": 0.12341})[0] == r"a & \textbf{0.1234} \\"


def test_alignment_comparison(spark):
    ddl = "ord long, s string, t string, relation string, measure double"
    a = table(spark, ddl, (0, "x", "y", "=", 1.0), (1, "u", "v", "=", 1.0))
    b = table(spark, ddl, (0, "u", "v", "=", 1.0), (1, "x", "y", "=", 1.0))
    assert Rep.compare_alignments(a, a).first().verdict == "same cells in order"
    assert Rep.compare_alignments(a, b).first().verdict == "same cells"
    assert Rep.compare_alignments(a, b.limit(1)).first().verdict == "different cells"
