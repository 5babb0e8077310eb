import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.functions import similarity
from kinweave.operators import decide, evaluate, graph, hops, sampling

PAIRS = "s1_id long, pool_id long, p double, is_s2 boolean, label int"


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(5)
    return [(e, c, round(rng.random(), 2), rng.random() < 0.5, int(rng.random() < 0.4)) for e in range(40) for c in rng.sample(range(30), rng.randrange(1, 9))]


def test_entity_context(spark, pairs):
    got = {(r["s1_id"], r["pool_id"]): r for r in graph.entity_context(spark.createDataFrame(pairs, PAIRS), ("s1_id", "is_s2"), "s_").collect()}
    for key, group in itertools.groupby(sorted(pairs, key=lambda r: (r[0], r[3])), lambda r: (r[0], r[3])):
        rows = sorted(group, key=lambda r: (-r[2], r[1]))
        ps = [r[2] for r in rows] + [0.0] * 3
        for k, r in enumerate(rows):
            g = got[r[0], r[1]]
            assert (g["s_rank"], g["s_count"], g["s_top1"], g["s_top2"], g["s_top3"]) == (k, len(rows), *ps[:3])
            assert g["s_best_other"] == (ps[1] if k == 0 else ps[0]) and g["s_n_ge_50"] == sum(x >= 0.5 for x in ps[: len(rows)])
            assert g["s_gap_to_best_other"] == pytest.approx(r[2] - g["s_best_other"]) and g["s_sum"] == pytest.approx(sum(ps))


def test_pool_competition_with_new_pairs(spark, pairs):
    rows = [(*r, int(r[0] % 5 == 0)) for r in pairs]
    df = spark.createDataFrame(rows, PAIRS + ", is_new int")
    got = {(r["s1_id"], r["pool_id"]): r for r in graph.pool_competition_new(df.where("is_new = 0"), df).collect()}
    clip = lambda p: min(max(p, 1e-6), 1 - 1e-6)
    for e, c, p, _, _, new in rows:
        p, others = clip(p), [clip(r[2]) for r in rows if r[1] == c and r[5] == 0 and r[0] != e]
        g = got[e, c]
        assert g["ps_n_claim"] == len(others) + 1 and g["ps_rank"] == sum(o > p for o in others)
        assert g["ps_sum_other"] == pytest.approx(sum(others)) and g["ps_n_other_ge50"] == sum(o >= 0.5 for o in others)
        odds = p / (1 - p)
        assert g["ps_q"] == pytest.approx(odds / (1 + odds + sum(o / (1 - o) for o in others)))
        assert g["ps_best_other"] == pytest.approx(max(others, default=0.0))


def test_pool_competition(spark, pairs):
    got = {(r["s1_id"], r["pool_id"]): r for r in graph.pool_competition(spark.createDataFrame(pairs, PAIRS)).collect()}
    for e, c, p, *_ in pairs:
        claims = sorted(((-r[2], r[0]) for r in pairs if r[1] == c))
        g = got[e, c]
        assert g["ps_rank"] == claims.index((-p, e)) and g["ps_n_claim"] == len(claims)


def test_siblings(spark):
    rng = random.Random(9)
    words = ["red", "blue", "green", "north", "lake"]
    rows = [(e, c, round(rng.random(), 2), " ".join(rng.sample(words, rng.randrange(0, 3))), " ".join(rng.sample(words, rng.randrange(0, 3)))) for e in range(6) for c in range(rng.randrange(1, 6))]
    got = {(r["s1_id"], r["pool_id"]): r for r in graph.siblings(spark.createDataFrame(rows, "s1_id long, pool_id long, p double, name string, addr string"), cap=4).collect()}
    for e, c, p, name, addr in rows:
        g, mine = got[e, c], sorted(r for r in rows if r[0] == e)[:4]
        others = [r for r in mine if r[1] != c] if any(r[1] == c for r in mine) else []
        if not others:
            assert g["sib_top_p"] is None and g["sib_n_agree"] == 0
            continue
        sims = [(similarity.token_set(name, r[3]) if name and r[3] else None, similarity.token_set(addr, r[4]) if addr and r[4] else None, r[2], r[1]) for r in others]
        assert g["sib_top_p"] == max(s[2] for s in sims)
        known = [(s[0], s[2]) for s in sims if s[0] is not None and s[2] > 0]
        if known:
            assert g["sib_wsim_name"] == pytest.approx(sum(a * w for a, w in known) / sum(w for _, w in known))
        agree = [s for s in sims if ((s[0] or -1) >= 0.8 and (s[1] or -1) >= 0.8) or (s[1] is None and (s[0] or -1) >= 0.9) or (s[0] is None and (s[1] or -1) >= 0.9)]
        assert g["sib_n_agree"] == sum(s[2] >= 0.5 for s in agree) and g["sib_best_agree_p"] == max((s[2] for s in agree), default=None)


def test_decision_modes(spark):
    rows = [(0, 0, 0.4, True, 0), (0, 1, 0.6, True, 0), (1, 2, 0.4, False, 0), (1, 3, 0.6, False, 0)]
    df = spark.createDataFrame(rows, PAIRS)
    keep = lambda d: [r["keep"] for r in d.orderBy("pool_id").collect()]
    assert keep(decide.decide(df)) == [False, True, False, True]
    assert keep(decide.decide(df, "per_source", s2=0.3, s3=0.5)) == [True, True, False, True]
    gated = spark.createDataFrame([(0, 0, 0.55, True, 0), (0, 1, 0.4, True, 0), (1, 2, 0.35, False, 0), (1, 3, 0.3, False, 0)], PAIRS)
    assert keep(decide.decide(gated, "gated", s2=0.3, s3=0.3, gate=0.5)) == [True, True, False, False]


def test_expected_f_is_enumeration():
    q, missed = np.array([0.9, 0.6, 0.3]), 0.12
    chances = [math.exp(-missed) * missed**m / math.factorial(m) for m in range(5)]
    chances[-1] += 1 - sum(chances)
    for k in range(4):
        want = 0.0
        for labels in itertools.product((0, 1), repeat=3):
            weight = math.prod(x if y else 1 - x for x, y in zip(q, labels))
            for m, c in enumerate(chances):
                tp, fp, fn = sum(labels[:k]), k - sum(labels[:k]), sum(labels[k:]) + m
                want += weight * c * (1.0 if tp + fp + fn == 0 else 1.25 * tp / (1.25 * tp + 0.25 * fn + fp))
        assert decide.expected_f(np.array([q, q / 2]), missed)[0, k] == pytest.approx(want)


def test_expected_decision_keeps_best(spark):
    df = spark.createDataFrame([(0, 0, 0.95, True, 1), (0, 1, 0.02, True, 0), (1, 2, 0.01, True, 0)], PAIRS)
    assert {r["pool_id"]: r["keep"] for r in decide.decide_expected(df).collect()} == {0: True, 1: False, 2: False}


def test_scores_of_worked_examples(spark):
    predicted = spark.createDataFrame([("a", "S2-47"), ("a", "S2-193"), ("a", "S3-812"), ("c", "S2-1")], "s1_id string, pool_id string")
    truth = spark.createDataFrame([("a", "S2-47"), ("a", "S3-812"), ("d", "S2-9")], "s1_id string, pool_id string")
    required = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "s1_id string")
    got = {r["s1_id"]: r for r in evaluate.score_pairs(predicted, truth, required).collect()}
    assert got["a"]["f05"] == pytest.approx(0.7142857, abs=1e-7)
    assert (got["b"]["f05"], got["c"]["f05"], got["d"]["f05"]) == (1.0, 0.0, 0.0) and got["b"]["precision"] is None


def test_sweep_equals_direct_scores(spark, pairs):
    df = spark.createDataFrame(pairs, PAIRS)
    required = df.groupBy("s1_id").agg(F.sum("label").alias("truth_size"))
    sweep = {round(r["threshold"], 2): r["macro_f05"] for r in evaluate.threshold_sweep(df, required).collect()}
    for t in (0.05, 0.3, 0.77, 0.99):
        assert sweep[t] == pytest.approx(evaluate.macro(df, required, F.col("p") >= t - 1e-9))


def test_sampling_is_disjoint_and_repeats(spark):
    df = spark.range(1000).withColumnRenamed("id", "s1_id")
    a, b = (sorted(map(tuple, sampling.split(df.repartition(n), "s1_id").collect())) for n in (1, 7))
    assert a == b and {x[1] for x in a} == {"train", "val", "hold"}
    assert sampling.sample(df, "s1_id", 10).count() == 10
    named = sampling.groups(df, "s1_id", {"x": 0.2, "y": 0.3}).groupBy("grp").count().collect()
    assert sum(r["count"] for r in named) == 1000 and len(named) == 3


def test_negatives(spark, pairs):
    got = sampling.negatives(spark.createDataFrame(pairs, PAIRS), 2, 1).collect()
    by = {e: [r for r in pairs if r[0] == e] for e in {r[0] for r in pairs}}
    for e, rows in by.items():
        mine = [r for r in got if r["s1_id"] == e]
        wrong = [r for r in rows if r[4] == 0]
        assert sum(r["label"] for r in mine) == sum(r[4] for r in rows)
        assert len(mine) - sum(r["label"] for r in mine) == min(len(wrong), 3)


def test_union_and_extension(spark):
    dense = spark.createDataFrame([(1, 2, 0.5, 3), (1, 2, 0.7, 1)], "s1_id long, pool_id long, dense_score double, dense_rank int")
    hop = spark.createDataFrame([(1, 3, 0.1, 0.9, 2)], "s1_id long, pool_id long, hop_rank double, hop_conf double, hop_n long")
    got = {r["pool_id"]: r for r in hops.union_sources(dense, hop).collect()}
    assert (got[2]["src_dense"], got[2]["src_hop"], got[2]["dense_score"], got[2]["dense_rank"], got[2]["hop_n"]) == (1, 0, 0.7, 1, None)
    first = spark.createDataFrame([(1, 2, 0.5, 0.5)], "s1_id long, pool_id long, ov_name double, filter_score double")
    with pytest.raises(Exception, match="candidate already"):
        hops.extend_candidates(first, spark.createDataFrame([(1, 2, 0.3)], "s1_id long, pool_id long, new_score double"), keys=("s1_id", "pool_id")).collect()


def test_dense_search(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(vectors)], "id long, label int, vec array<double>")
    got = {(r["q_id"], r["dense_rank"]): r["p_id"] for r in hops.dense_search(df.where("id % 10 = 0"), df, k=5, block_rows=2).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q in range(0, 60, 10):
        order = sorted((p for p in range(60) if p != q and p % 2 == q % 2), key=lambda p: -unit[q] @ unit[p])
        assert [got[q, k + 1] for k in range(5)] == order[:5]


def test_street_swaps(spark):
    rows = [(f"e{i}", f"{i + 1} {s} street, Town") for i, s in enumerate(["alder", "birch", "cedar"])] + [("x", "nowhere"), ("y", None)]
    got = sampling.street_swaps(spark.createDataFrame(rows, "entity_id string, address string"), "address", 2).collect()
    assert len(got) == 2
    for r in got:
        assert r["swapped"].split()[0] == r["address"].split()[0] and r["swapped"].endswith(", town") and r["swapped"].split()[1] not in r["address"].lower()


def test_ascent_tries_the_whole_grid(spark):
    rng = random.Random(3)
    rows = []
    for e in range(60):
        for c in range(rng.randrange(1, 5)):
            y = int(rng.random() < 0.4)
            rows.append((e, len(rows), min(0.99, max(0.01, round(rng.gauss(0.7 if y else 0.4, 0.2), 4))), rng.random() < 0.5, y))
    df = spark.createDataFrame(rows, PAIRS)
    required = df.groupBy("s1_id").agg(F.sum("label").alias("truth_size"))

    def score(gate, s2, s3):
        total = 0.0
        for e in range(60):
            mine = [r for r in rows if r[0] == e]
            kept = [r for r in mine if r[2] >= (s2 if r[3] else s3) - 1e-12] if max(r[2] for r in mine) >= gate else []
            tp, truth = sum(r[4] for r in kept), sum(r[4] for r in mine)
            total += float(not kept) if not truth else 1.25 * tp / (1.25 * tp + 0.25 * (truth - tp) + len(kept) - tp)
        return total / 60

    for gated in (False, True):
        at = {"gate": 0.0, "s2": 0.5, "s3": 0.5}
        best = score(**at)
        for _ in range(3):
            for name in (("gate",) if gated else ()) + ("s2", "s3"):
                for g in range(5, 100):
                    value = score(**(at | {name: g / 100}))
                    if value > best + 1e-12:
                        best, at = value, at | {name: g / 100}
        got = evaluate.coordinate_ascent(df, required, 0.5, gated=gated)
        assert got["macro_f05"] == pytest.approx(best) and all(got[k] == pytest.approx(v) for k, v in at.items())


def test_auc_of_continuous_scores(spark):
    rng = random.Random(5)
    rows = [(i, i, rng.choice([rng.random(), 0.25, -3.0 * rng.random(), 7.5]), True, int(rng.random() < 0.3)) for i in range(500)]
    got = evaluate.auc(spark.createDataFrame(rows, PAIRS)).first()["auc"]
    wins = [(p > n) + 0.5 * (p == n) for _, _, p, _, y in rows if y for _, _, n, _, z in rows if not z]
    assert got == pytest.approx(sum(wins) / len(wins))


def test_floor_and_share_of_new_pairs(spark):
    table = spark.createDataFrame([(0.01, 9.0, 1.0), (0.05, 5.0, 0.996), (0.2, 2.0, 0.9)], "floor double, candidates_per_entity double, recall_all_true_pairs double")
    assert [r["floor"] for r in evaluate.floor_by_budget(table).collect()] == [0.05] and evaluate.floor_by_budget(table, 1.1).count() == 0
    rows = [(0, i, p, True, 0) for i, p in enumerate([0.9, 0.85, 0.82, 0.815, 0.1])] + [(1, 9, 0.2, True, 0), (1, 8, 0.17, True, 0)]
    assert {r["pool_id"] for r in evaluate.keep_share(spark.createDataFrame(rows, PAIRS)).collect()} == {0, 1, 2, 9}


def test_unknown_records_break_the_output(spark):
    kept = spark.createDataFrame([("a", "S2-1"), ("a", "S9-1")], "s1_id string, pool_id string")
    known = spark.createDataFrame([("S2-1",)], "pool_id string")
    got = decide.broken_invariants(kept, kept, kept.select("s1_id"), known=known).collect()
    assert [(r["pool_id"], r["problem"]) for r in got] == [("S9-1", "unknown record")]
