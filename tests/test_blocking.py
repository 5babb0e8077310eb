import math
import random
from collections import Counter, defaultdict

import pytest

from kinweave.operators import blocking
from kinweave.operators.blocking import Config

SCHEMA = "country string, id string, name_tokens array<string>, address_tokens array<string>, name_normalized string, name_compact string, name_core string, postal_code string"


def record(i, name, addr, postal=None):
    return ("xx", i, name, addr, " ".join(name), "".join(name), " ".join(name), postal)


def generate(seed, n_pool=120, n_query=30):
    rng = random.Random(seed)
    pool = [record(f"p{i:03}", [f"n{int(rng.paretovariate(0.8)) % 30}" for _ in range(rng.randrange(5))], [f"a{int(rng.paretovariate(0.8)) % 60}" for _ in range(rng.randrange(7))], rng.choice([None, None, "1", "2"])) for i in range(n_pool)]
    query = []
    for i in range(n_query):
        base = rng.choice(pool) if i % 3 == 0 else rng.choice(pool)
        name = list(base[2]) if i % 3 == 0 else [f"n{int(rng.paretovariate(0.8)) % 35}" for _ in range(rng.randrange(5))]
        addr = list(base[3]) if i % 3 == 0 else [f"a{int(rng.paretovariate(0.8)) % 70}" for _ in range(rng.randrange(7))]
        query.append(record(f"q{i:03}", name, addr, base[7]))
    return query, pool


def brute(query, pool, cfg):
    out = defaultdict(lambda: Counter())
    weight = defaultdict(lambda: Counter())
    n = len(pool)
    for field, k, label in ((2, cfg.k_name, "name"), (3, cfg.k_address, "addr")):
        held = defaultdict(set)
        for p in pool:
            for t in p[field]:
                held[t].add(p[1])
        for q in query:
            known = sorted({t for t in q[field] if t in held and len(held[t]) <= cfg.df_cap}, key=lambda t: (len(held[t]), t))[:k]
            for t in known:
                for p in held[t]:
                    out[q[1], p][f"n_{label}_shared"] += 1
                    weight[q[1], p][f"idf_{label}"] += math.log((n + 1) / (len(held[t]) + 1))

    def bigrams(words):
        return [tuple(sorted(x)) for x in zip(words, words[1:])]

    families = {
        "exact_name": (lambda r: [r[4]] if r[4] else [], cfg.exact_cap), "exact_compact": (lambda r: [r[5]] if r[5] else [], cfg.exact_cap), "postal_eq": (lambda r: [r[7]] if r[7] else [], cfg.exact_cap),
        "n_name_bigram": (lambda r: bigrams(r[2]), cfg.name_bigram_cap), "n_addr_bigram": (lambda r: bigrams(r[3]), cfg.address_bigram_cap), "n_prefix": (lambda r: [r[5][:4]] if len(r[5]) >= 4 else [], cfg.prefix_cap),
    }
    for name, (keys, cap) in families.items():
        held = defaultdict(list)
        for p in pool:
            for key in keys(p):
                held[key].append(p[1])
        for q in query:
            for key in keys(q):
                if len(held[key]) <= cap:
                    for p in held[key]:
                        out[q[1], p][name] += 1
    for pair, c in out.items():
        for name in ("exact_name", "exact_compact", "postal_eq", "n_prefix"):
            c[name] = min(c[name], 1)
    return out, weight


@pytest.mark.parametrize("seed", [0, 1])
def test_evidence_equals_brute_force(spark, seed):
    cfg = Config(df_cap=12, k_name=2, k_address=3, exact_cap=40, name_bigram_cap=10, address_bigram_cap=10, prefix_lengths=(4,), prefix_cap=30)
    query, pool = generate(seed)
    want, weight = brute(query, pool, cfg)
    got = {(r["s1_id"], r["pool_id"]): r for r in blocking.evidence(spark.createDataFrame(query, SCHEMA), spark.createDataFrame(pool, SCHEMA), cfg).collect()}
    assert set(got) == set(want)
    for pair, r in got.items():
        for c in blocking.EVIDENCE:
            value = weight[pair][c] if c.startswith("idf") else want[pair][c]
            assert r[c] == pytest.approx(value), (pair, c)


def test_leading_zeros_meet(spark):
    pool = [record("p", ["010001", "mabelvale", "plaza"], []), record("o", ["77", "other"], [])]
    query = [record("q", ["10001", "mabelvale", "plaza"], [])]
    got = blocking.evidence(spark.createDataFrame(query, SCHEMA), spark.createDataFrame(pool, SCHEMA), Config(prefix_lengths=())).collect()
    assert [(r["pool_id"], r["n_name_shared"], r["n_name_bigram"]) for r in got] == [("p", 3, 2)]


def test_overlap_finds_what_rare_tokens_miss(spark):
    words = ["pediatric", "dental", "associates"]
    pool = [record(f"p{i:03}", [w for j, w in enumerate(words) if j != i % 3] + [f"x{i}"], [f"n{i}"] + (["dalles"] if i < 300 else [])) for i in range(700)] + [record("p700", words, ["dalles"])]
    query = [record("q", words, ["dalles"])]
    cfg = Config(df_cap=400, k_name=3, k_address=3, exact_cap=0, name_bigram_cap=0, address_bigram_cap=0, prefix_lengths=(), max_candidates=5)
    got = blocking.block(spark.createDataFrame(query, SCHEMA), spark.createDataFrame(pool, SCHEMA), cfg).orderBy("place").collect()
    assert got[0]["pool_id"] == "p700" and len(got) == 5


def test_select_top_with_floor(spark):
    rng = random.Random(3)
    rows = [("xx", f"e{e}", f"c{c:02}", rng.randrange(12) / 12) for e in range(10) for c in range(25)]
    df = spark.createDataFrame(rows, "country string, s1_id string, pool_id string, score double")
    got = {(r["s1_id"], r["pool_id"]) for r in blocking.select_top(df, "score", 8, floor=0.7, keep=2).collect()}
    want = set()
    for e in range(10):
        mine = sorted((r for r in rows if r[1] == f"e{e}"), key=lambda r: (-r[3], r[2]))[:8]
        want |= {(r[1], r[2]) for k, r in enumerate(mine) if r[3] >= 0.7 or k < 2}
    assert got == want


def test_empty_sides_give_nothing(spark):
    empty, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([record("a", ["x"], ["y"])], SCHEMA)
    assert blocking.block(empty, one).count() == 0 and blocking.block(one, empty).count() == 0
