import random
import time

import pytest

from kinweave.functions import similarity, text
from kinweave.operators import graph


def rows(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.withColumn("y", f).orderBy("i").collect()]


def test_normalised_names(spark):
    raw = [("S1-1", "Payne Énterprises", None), ("S1-2", "Ram Marketing Private Limited", "1795 Westchester Drive, High Point, NC"), ("S1-3", "B & C", "175 Boulevard du Président Franklin Roosevelt, Bordeaux, 33000"), ("S1-4", "குளோபல்", ""), ("S1-5", None, "007 X")]
    df = spark.createDataFrame([(*r, "xx", "S1") for r in raw], "entity_id string, business_name string, business_address string, country string, source string")
    got = {r["entity_id"]: r for r in text.normalize_records(df).collect()}
    assert got["S1-1"]["name_normalized"] == "payne enterprises" and got["S1-1"]["name_script"] == "latin_accent"
    assert got["S1-2"]["name_normalized"] == "ram marketing pvt ltd" and got["S1-2"]["name_core"] == "ram marketing"
    assert got["S1-2"]["address_normalized"] == "1795 westchester dr high point nc"
    assert got["S1-3"]["name_normalized"] == "b and c" and got["S1-3"]["postal_code"] == "33000" and got["S1-3"]["house_number"] == "175"
    assert got["S1-4"]["name_script"] == "tamil" and got["S1-4"]["address_tokens"] == [] and got["S1-4"]["postal_code"] is None
    assert got["S1-5"]["name_tokens"] == [] and got["S1-5"]["house_number"] == "007"


def test_transliteration(spark):
    assert text.transliterate("लिमिटेड") == "limiteda"
    assert rows(spark, text.clean(text.F.col("x")), ["राज", "Straße œuvre", "ﬁn", None]) == ["raaja", "straße œuvre", "fin", ""]


def test_house_and_postal(spark):
    assert rows(spark, text.house_number(text.F.col("x")), ["12B Main", "12b Main", "x 1", ""]) == [None, "12b", None, None]
    assert rows(spark, text.postal_code(text.F.col("x")), ["a 12345-6789", "411001 and 12345", "1234567", "x12345y"]) == ["12345", "411001", None, "12345"]
    assert rows(spark, text.strip_leading_zeros(text.F.col("x")), ["019", "0", "00", "a01"]) == ["19", "0", "0", "a01"]


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_ratio_is_indel():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randrange(12))) for _ in range(2))
        want = 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0
        assert similarity.ratio(a, b) == pytest.approx(want)


def test_token_scorers():
    assert similarity.token_sort("b a", "a b") == 1.0
    assert similarity.token_set("a b c", "a b") == 1.0 and similarity.token_set("", "a") == 0.0
    assert similarity.token_set("x y", "z") == similarity.ratio("x y", "z")
    assert similarity.partial("abc", "xxabcxx") == 1.0 and similarity.partial("", "") == 1.0 and similarity.partial("", "a") == 0.0
    assert similarity.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert similarity.jaro_winkler("", "") == 1.0 and similarity.jaro_winkler("a", "") == 0.0


def test_scores_are_null_on_empty_sides(spark):
    df = spark.createDataFrame([("a b", "a b"), ("", "x"), (None, "x")], "a string, b string")
    got = df.select(similarity.scores(df.a, df.b).alias("s")).collect()
    assert got[0]["s"]["ratio"] == 1.0 and got[1]["s"]["ratio"] is None and got[2]["s"]["jw"] is None
    kept = df.select(similarity.scores(df.a, df.b, ("token_set",), empty_is_null=False).alias("s")).collect()
    assert kept[1]["s"]["token_set"] == 0.0


def test_addresses(spark):
    cases = {
        "12 rue de la Paix, Paris": ("12", "paix", "paris"), "Mall, 0045 Main Street, X": ("45", "main", "mall x"), "Main Street, Town": (None, "main", "town"), "Nowhere": (None, "", "nowhere"), None: (None, "", ""), "": (None, "", ""),
        " , (no. 7) - bis Chemin des Érables ,, Étage 2": ("7", "erables", "etage 2"), "Street, Low Road, 3 B": (None, "low", "street 3 b"), "000 Che Str Haut": ("0", "haut", ""), "5 x, 6 Oak Ave": ("6", "oak", "5 x"), "मार्ग 4 road": (None, "4", ""),
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", graph.parsed_address("t").alias("a")).orderBy("i").collect()
    assert [tuple(r["a"]) for r in rows] == list(cases.values())


def test_partial_is_symmetric_at_equal_lengths():
    from kinweave.functions import similarity

    assert similarity.partial("aababb", "cacbbc") == similarity.partial("cacbbc", "aababb") == pytest.approx(2 / 3)
    assert similarity.partial("abc", "xxabcxx") == 1.0


def test_robust_features_leave_out_what_grows_with_the_pool():
    from kinweave.operators import models

    assert models.feature_columns(["rank_score", "s1_core_freq", "s1_addr_freq", "idf_name", "name_script_1", "label"], robust=True) == ["rank_score"]
    assert models.feature_columns(["s1_core_freq", "name_script_match"]) == ["s1_core_freq"]


def slow_partial(a, b):
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return float(not b)
    found = max(similarity.ratio(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))
    return max(found, *(similarity.ratio(b, a[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(a)))) if len(a) == len(b) else found


def slow_token_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common = x & y
    if common and common in (x, y):
        return 1.0
    both = " ".join(sorted(common))
    left, right = (" ".join(filter(None, [both, " ".join(sorted(s - common))])) for s in (x, y))
    return max([similarity.ratio(left, right)] + ([similarity.ratio(both, left), similarity.ratio(both, right)] if common else []))


def test_similarities_of_many_pairs_are_those_of_each(monkeypatch):
    rng = random.Random(3)
    pairs = [tuple("".join(rng.choice("ab cdé日") for _ in range(rng.choice((0, 1, 2, 5, 12, 40)))) for _ in range(2)) for _ in range(1500)]
    for together in (similarity.COMBED_TOGETHER, 50):
        monkeypatch.setattr(similarity, "COMBED_TOGETHER", together)
        assert similarity.partials(pairs) == [slow_partial(*p) for p in pairs]
    assert [similarity.token_set(*p) for p in pairs] == [slow_token_set(*p) for p in pairs]
    assert similarity.partials([]) == []


def test_partial_of_long_texts_ends():
    rng = random.Random(4)
    pairs = [tuple("".join(rng.choice("abcdefgh ") for _ in range(160)) for _ in range(2)) for _ in range(3000)]
    begin = time.process_time()
    assert len(similarity.partials(pairs)) == 3000
    assert time.process_time() - begin < 15  # the windows one by one took about 80
