"""Every query of the linkage engine against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from kinweave import plans
from kinweave.functions import similarity
from kinweave.operators import evaluate, features, models
from kinweave.plans import fixtures
from kinweave.sources import io

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries without SQL that have a test of their own below.
TESTED = {"matcher_features", "graph_features", "filter_features", "similarity_scores", "threshold_ascent", "new_pair_features"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return float(value) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    found = duck.execute(plans.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in found.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL) - TESTED))
def test_query_without_sql_runs(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(plans.SQL) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def linked(duck):
    """The candidates by SQL, with both sides' normalised texts."""
    sides = "a.name_normalized as n1, b.name_normalized as n2, a.address_normalized as a1, b.address_normalized as a2"
    found = duck.execute(f"with {fixtures.RECORDS_SQL} {fixtures.block_sql()} select r.s1_id, r.pool_id, r.rank_score, {sides} from ranked r join recs a on a.entity_id = r.s1_id join recs b on b.entity_id = r.pool_id")
    names = [d[0] for d in found.description]
    return {(r[0], r[1]): dict(zip(names, r, strict=True)) for r in found.fetchall()}


def by_pair(df):
    rows = df.collect()
    out = {(r["s1_id"], r["pool_id"]): r for r in rows}
    assert len(out) == len(rows)
    return out


def plain_ratio(a, b):
    """Twice the longest common subsequence by the whole table of the textbook recurrence."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return 2 * best[-1][-1] / (len(a) + len(b))


def same(got, want):
    return got is None if want is None else got == pytest.approx(want, abs=1e-9)


def test_similarity_scores(spark, duck, linked):
    got = by_pair(plans.QUERIES["similarity_scores"](spark, DATA))
    assert got.keys() == linked.keys() and len(got) > 100
    for key, row in linked.items():
        a, b = row["n1"], row["n2"]
        full = a and b
        # DuckDB counts bytes: other letters of these lower-case names become capitals, one each
        letters = str.maketrans({c: chr(65 + k) for k, c in enumerate(sorted({c for c in a + b if not c.isascii()}))})
        jw = duck.execute("select jaro_winkler_similarity(?, ?)", [a.translate(letters), b.translate(letters)]).fetchone()[0] if full else None
        want = {"ratio": plain_ratio(a, b), "token_sort": plain_ratio(*(" ".join(sorted(x.split())) for x in (a, b))), "jw": jw} if full else dict.fromkeys(similarity.SCORERS)
        assert all(same(got[key][k], v) for k, v in want.items())
        if full:
            assert same(got[key]["token_set"], similarity.token_set(b, a)) and same(got[key]["partial"], similarity.partial(b, a))


def test_new_pair_features(spark, linked):
    got = by_pair(plans.QUERIES["new_pair_features"](spark, DATA))
    assert got.keys() == linked.keys()
    for key, row in linked.items():
        for kind, a, b in (("name", row["n1"], row["n2"]), ("addr", row["a1"], row["a2"])):
            assert same(got[key][f"nf_{kind}_ratio"], plain_ratio(a, b) if a or b else 1.0)
            assert same(got[key][f"nf_{kind}_set"], similarity.token_set(a, b))
        assert got[key]["nf_addr_empty"] == (row["a2"] == "")


def test_filter_features(spark, linked):
    df = plans.QUERIES["filter_features"](spark, DATA)
    assert df.columns == ["country", "s1_id", "pool_id", *features.FILTER_FEATURES] and len(features.FILTER_FEATURES) == 26
    assert by_pair(df).keys() == linked.keys()


def test_matcher_features(spark, linked):
    got = by_pair(plans.QUERIES["matcher_features"](spark, DATA))
    assert got.keys() == linked.keys()
    sizes, best = {}, {}
    for (s1, _), row in linked.items():
        sizes[s1] = sizes.get(s1, 0) + 1
        best[s1] = max(best.get(s1, 0.0), row["rank_score"])
    for key, row in linked.items():
        f = got[key]
        assert same(f["name_ratio"], plain_ratio(row["n1"], row["n2"]) if row["n1"] and row["n2"] else None)
        assert same(f["addr_ratio"], plain_ratio(row["a1"], row["a2"]) if row["a1"] and row["a2"] else None)
        assert f["n_candidates_for_entity"] == sizes[key[0]] and same(f["block_gap_to_best"], best[key[0]] - row["rank_score"])


def test_graph_features(spark, linked):
    got = by_pair(plans.QUERIES["graph_features"](spark, DATA))
    assert got.keys() == linked.keys()
    p = {k: min(r["rank_score"] / 2.5, 1.0) for k, r in linked.items()}
    total, claims = {}, {}
    for (s1, pool), x in p.items():
        total[s1], claims[pool] = total.get(s1, 0.0) + x, claims.get(pool, 0) + 1
    assert all(same(got[k]["e_sum"], total[k[0]]) and got[k]["ps_n_claim"] == claims[k[1]] for k in p)


def test_threshold_ascent(spark):
    rows = {r["mode"]: r for r in plans.QUERIES["threshold_ascent"](spark, DATA).collect()}
    pairs = [r.asDict() for r in fixtures.scored_pairs(spark, DATA).collect()]
    truth = {r["s1_id"]: r["truth_size"] for r in fixtures.entities(spark, DATA).collect()}
    top = {}
    for r in pairs:
        top[r["s1_id"]] = max(top.get(r["s1_id"], 0.0), r["p"])

    def score(c):
        tp, n = dict.fromkeys(truth, 0), dict.fromkeys(truth, 0)
        for r in pairs:
            if r["s1_id"] in truth and r["p"] >= (c["s2"] if r["is_s2"] else c["s3"]) and top[r["s1_id"]] >= c["gate"]:
                n[r["s1_id"]] += 1
                tp[r["s1_id"]] += r["label"]
        return sum(1.25 * tp[e] / (0.25 * t + n[e]) if t else n[e] == 0 for e, t in truth.items()) / len(truth)

    assert set(rows) == {"per_source", "gated"}
    swept = evaluate.best_threshold(plans.QUERIES["threshold_sweep"](spark, DATA))[1]  # rounded to 6 places
    assert rows["gated"]["macro_f05"] >= rows["per_source"]["macro_f05"] - 1e-9 and rows["per_source"]["macro_f05"] >= swept - 1e-6
    for c in rows.values():
        assert c["macro_f05"] == pytest.approx(score(c), abs=1e-9)


def test_metadata_mismatch_raises(spark, tmp_path):
    path = f"file://{tmp_path}/meta"
    io.write_metadata(spark, path, {"cap": 300})
    io.check_metadata(spark, path, {"cap": 300})
    with pytest.raises(ValueError, match="cap"):
        io.check_metadata(spark, path, {"cap": 20})


def test_trees_ensemble_and_importances(spark):
    rows = spark.range(200).selectExpr("id as s1_id", "id % 7 as a", "(id * 37) % 11 as b", "cast(id % 7 > 3 as int) as label")
    members = [models.fit(rows, ("a", "b"), seed=s, rounds=3) for s in (1, 2)]
    scored = models.ensemble(members, rows, ("a", "b")).collect()
    assert all((r["p"] > 0.5) == bool(r["label"]) for r in scored)
    assert models.importances(members[0], ("a", "b"))[0][0] == "a"
