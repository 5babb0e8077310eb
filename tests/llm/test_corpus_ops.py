"""Dedup, near-dedup, mixing, URL filters, WARC, audio and the pipeline against brute force and edge cases."""

import hashlib
import io as stdio
import random
from collections import defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from kinweave.llm import audio, common, components, exact_dedup, minhash, mixing, url_filters, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---- exact dedup


def test_exact_dedup_with_frequent_texts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FREQUENT_COPIES", 5)
    monkeypatch.setattr(exact_dedup, "SAMPLE_PER_PARTITION", 40)
    rng = random.Random(1)
    texts = [None, "", "A", "a", "a ", "hot", *[f"t{i}" for i in range(30)], "x" * 50_000]
    rows = [(i, "hot" if rng.random() < 0.4 else rng.choice(texts), "en", "s", 1) for i in range(400)]
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    assert len(got) == 400
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(ids), len(ids), i == max(ids))
            assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    kept = exact_dedup.without_copies(spark.createDataFrame(rows, DOCS))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ") and {r["doc_id"] for r in kept.collect()} == {max(v) for v in groups.values()}


def test_exact_dedup_odd_rows(spark):
    rows = [(1, "a", "kept?"), (1, "a", "kept?"), (None, "a", None), (None, "b", None), (2, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Kept string")
    got = exact_dedup.exact_dedup(df)
    assert [c.lower() for c in got.columns].count("kept") == 1
    by = sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in got.collect())
    assert by == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True), (2, 2, 1, True)]
    assert exact_dedup.without_copies(df).columns == df.columns and exact_dedup.without_copies(df).count() == 4
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


# ---- near-duplicates


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def near_corpus(seed, n_groups=6, size=30, words=60):
    rng = random.Random(seed)
    rows, shared = [], [f"common{j}" for j in range(20)]
    for g in range(n_groups):
        base = [f"g{g}w{rng.randrange(1000)}" for _ in range(words)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randrange(0, 5)):
                text[rng.randrange(words)] = f"e{rng.randrange(10_000)}"
            rows.append((len(rows), " ".join(text + shared if rng.random() < 0.3 else text)))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", " \t\n", "one", "One", "one two", "ONE\ttwo", "a b c", "x " * 3000, "x " * 2000])]
    return rows


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 3, 85), (2, 5, 80)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, seed, width, percent):
    monkeypatch.setattr(minhash, "SMALL_KEY", 4)
    monkeypatch.setattr(minhash, "TILE", 8)
    monkeypatch.setattr(minhash, "PAIRS_TOGETHER", 8)
    rows = near_corpus(seed)
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, keys string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, width=width, percent=percent).collect()}
    assert got == brute_components(rows, width, percent)


def test_near_duplicates_odd_rows(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (7, "a b c d e f g"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert got == [(0, 0, True), (5, 5, True), (5, 5, True), (7, 5, False), (8, 8, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    kept = minhash.without_near_duplicates(df.withColumn("kept", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "kept"] and kept.count() == 4


def test_keys_guarantee_the_distance():
    rng = np.random.default_rng(4)
    places = minhash.CHUNKS * minhash.WIDTH
    for _ in range(300):
        x = rng.integers(0, 1 << minhash.BITS, places, dtype=np.uint64)
        y = x.copy()
        at = rng.choice(places, minhash.GUARANTEED, replace=False)
        y[at] ^= np.uint64(1)
        assert minhash.distance(x, y) == minhash.GUARANTEED and minhash.share_a_key(x, y)
    z = rng.integers(0, 1 << minhash.BITS, places, dtype=np.uint64)
    assert not minhash.share_a_key(x, z)


def test_tile_links_are_all_similar_pairs():
    rng = random.Random(6)
    sets = [np.unique(np.array(rng.sample(range(40), rng.randrange(0, 30)), np.uint64)) for _ in range(60)]
    got = set(minhash.tile_links(sets[:20], sets, 50))
    want = {(i, j) for i in range(20) for j in range(60) if (a := set(sets[i].tolist())) & (b := set(sets[j].tolist())) and 100 * len(a & b) >= 50 * len(a | b)}
    assert got == want and all(minhash.similar(sets[i], sets[j], 50) == ((i, j) in want) for i in range(20) for j in range(60) if len(sets[i]) and len(sets[j]))


def test_near_duplicates_by_words_not_hashes(spark):
    def word(n, flip):
        return "".join("ab"[(bin(i).count("1") + flip) & 1] for i in range(n))

    rows = [(1, " ".join(word(1024, k % 2) for k in range(3))), (2, " ".join(word(1024, (k + 1) % 2) for k in range(3))), (3, "x y z"), (4, "X\tY z")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3}


def test_repeated_ids_with_different_texts(spark):
    x, y = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, x), (1, y), (2, x), (3, y), (1, None), (9, "other words than these six here")]
    runs = []
    for n in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        runs.append(sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, width=3, percent=85).collect()))
    assert runs[0] == runs[1] and len(runs[0]) == 6
    # id 1 is the document of one of its texts, so it links with 2, with 3 or with neither
    by = {i: c for i, _, c, _ in runs[0]}
    assert by[1] == 1 and [by[2], by[3]] in ([1, 3], [2, 1], [2, 3]) and by[9] == 9


def test_recall_over_thousands_of_rows(spark):
    """Families whose similarity straddles the threshold, against an exact inverted index over all rows."""
    rng = random.Random(12)
    rows = []
    for g in range(400):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 90))]
        for _ in range(8):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(text) // 25)):
                text[rng.randrange(len(text))] = f"w{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()}
    sets = {i: minhash.word_shingles(t, 3) for i, t in rows}
    index = defaultdict(list)
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for i in sorted(sets):
        common = defaultdict(int)
        for s in sets[i]:
            for j in index[s]:
                common[j] += 1
            index[s].append(i)
        for j, n in common.items():
            if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                links += 1
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    assert links > 3000 and got == {i: top(i) for i in sets}


def test_many_ids_are_not_broadcast(spark, monkeypatch):
    """More ids than ``BROADCAST_ROWS`` meet their texts without a broadcast that the driver would have to build."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 20)
    plans, write = {}, minhash.cut

    def cut(df, label):
        plans[label] = df._jdf.queryExecution().analyzed().toString()
        return write(df, label)

    monkeypatch.setattr(minhash, "cut", cut)
    rows = near_corpus(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()}
    assert got == brute_components(rows, 3, 85)
    assert "LeftSemi" in plans["texts"] and "broadcast" not in plans["texts"] and "shuffle_hash" in plans["texts"]


@pytest.mark.parametrize(("few", "kind"), [(0, "long"), (40, "long"), (1 << 14, "long"), (40, "string"), (1 << 14, "string"), (1 << 14, "double")])
def test_components_whether_few_edges_or_many(spark, monkeypatch, few, kind):
    """Few edges take one write after the edges' own, at whichever round they get few; rounds before that give the same."""
    monkeypatch.setattr(components, "FEW_EDGES", few)
    written, write = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df, label: written.append(label) or write(df, label))
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(150, 20, -1)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(None, 3), (9, 9)]
    df = spark.createDataFrame(edges, "a long, b long").select(F.col("a").cast(kind), F.col("b").cast(kind))
    value = {"long": int, "string": str, "double": float}[kind]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = top(value(a)), top(value(b))
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components.components(df, "a", "b").collect()}
    assert got == {x: top(x) for x in parent}
    if few > len(edges) and kind != "double":
        assert written == ["edges", "pointers"]


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + k) for k in range(50)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(7, 7), (None, 3), (100, 101)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: top(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# ---- mixing


def water_fill(sizes, weights, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, list(names), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if most * sizes[s] < level * weight[s]]
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mix_meets_targets(spark, seed):
    rng = random.Random(seed)
    sources = ["b", "a", "é", "Z", None, "tiny", "empty"]
    rows = []
    for i in range(400):
        s = "a" if rng.random() < 0.4 else rng.choice(sources)
        n = 0 if s == "empty" else 1 if s == "tiny" else rng.randrange(0, 40)
        rows.append((i, " \n".join(["w"] * n) if rng.random() < 0.95 else None, "en", s, 1))
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).collect()
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = water_fill(sizes, (1, 2, 3), 3)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == len((rows[r["doc_id"]][1] or "").split()) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        assert r["position"] is None if not r["taken"] else 0 <= r["position"] <= 1
        taken[r["source"]] += r["taken"]
    assert len(got) == 400 and all(taken[s] == int(want[s] + 1e-9) for s in taken)
    assert sorted(got) == sorted(mixing.mix(df.repartition(5)).collect())


def test_schedule_is_inverted(spark):
    knots = ((0.0, 0.2), (0.3, 2.0), (1.0, 0.0))
    got = [r[0] for r in spark.range(0, 101).select(mixing.invert_schedule(F.col("id") / 100.0, knots)).collect()]
    t = np.linspace(0, 1, 20_001)
    w = np.interp(t, *zip(*knots, strict=True))
    done = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
    for share, when in zip(np.arange(101) / 100, got, strict=True):
        assert np.interp(when, t, done / done[-1]) == pytest.approx(share, abs=1e-3)
    assert got == sorted(got)
    with pytest.raises(ValueError):
        mixing.invert_schedule(F.lit(0.5), ((0.0, -1.0), (1.0, 1.0)))


def test_mixed_documents_are_in_training_order(spark):
    rows = [(i, "w " * (i % 7), "en", "abc"[i % 3], 1) for i in range(60)]
    df = spark.createDataFrame(rows, DOCS).withColumn("position", F.lit("clash"))
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    plan = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    copies = defaultdict(int)
    for r in got.collect():
        copies[r["doc_id"]] += 1
    assert all(copies[i] == (-(-r["taken"] // r["size"]) if r["size"] else 0) for i, r in plan.items())
    assert mixing.mixed_documents(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_mixing_null_and_repeated_ids(spark):
    rows = [(None, "w " * (i % 5 + 1) + str(i), "en", "a" if i % 2 else None, 1) for i in range(40)] + [(7, "x y z", "en", "b", 1)] * 30 + [(8, f"v{i}", "en", "b", 1) for i in range(10)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).collect()
    taken, want = defaultdict(int), {r["source"]: int(r["target"] + 1e-9) for r in got}
    for r in got:
        taken[r["source"]] += r["taken"]
    assert len(got) == 80 and dict(taken) == want
    copies = defaultdict(int)
    for r in mixing.mixed_documents(df).collect():
        copies[r["source"]] += len(r["text"].split())
    # whole documents: a source exceeds its target by less than its longest
    assert all(want[s] <= copies[s] < want[s] + 7 for s in want)
    assert sorted(map(str, mixing.mixed_documents(df).collect())) == sorted(map(str, mixing.mixed_documents(df.repartition(3)).collect()))


# ---- URL filters

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "", "allow"), ("net", "", "block"), (None, "/", "block"), ("a.b", None, "block")]
URLS = ["http://Example.COM/en/x", "https://www.example.com/en/1?q#f", "http://x.www.example.com/en/", "ftp://example.com", "http://example.com?x", "http://net/es/", "http://a.net/fr", "//no", None, "", "http://", "http://.com/", "http://notexample.com/en/", "http://a.b", "http://c.a.b/x", "http://example.com:80/en/", "x://y://com/"]


def judge(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = rest.split("/")[0].split("?")[0].split("#")[0].translate({c: c + 32 for c in range(65, 91)})
    path = rest[len(host) :].split("?")[0].split("#")[0]
    fits = [(len(h + (p or "")), len(h), v == "block", h + (p or ""), v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_url_filter_equals_plain_rules(spark):
    rng = random.Random(3)
    urls = URLS + [f"http://{rng.choice(['', 'w.', 'www.'])}{rng.choice(['example', 'e', 'a.b'])}.{rng.choice(['com', 'net', 'b'])}{rng.choice(['', '/', '/en/', '/es/x', '/fr/'])}" for _ in range(400)] + ["http://hot.com/"] * 300
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, Key string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.url_filter(pages, rules).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert got[i] == judge(u, RULES), u
    assert url_filters.url_filter(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filters.url_filter(pages, rules.limit(0)).collect()} == {"allow"}
    for kind in ("smallint", "decimal(9,0)", "string", "binary"):
        other = url_filters.url_filter(pages.withColumn("page_id", F.col("page_id").cast("string").cast(kind)), rules)
        assert dict(other.dtypes)["page_id"] == kind and other.count() == len(urls)


# ---- WARC


def test_archive_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (9, "http://b", big), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "z" * 700_000), (None, "u", big), (None, "u", "only null" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = f"file://{tmp_path}/bundles"
    got = {(r["page_id"], r["payload_bytes"]): r for r in warc.archive_and_read(pages, path).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        raw = (h or "").encode()
        r = got[i, len(raw)]
        revisit = h == big and i != 9
        assert r["payload_digest"] == hashlib.sha1(raw).hexdigest() and r["record_type"] == ("revisit" if revisit else "response") and r["refers_to"] == (9 if revisit else None)
    payloads = {r["record_id"]: r["payload"] for r in warc.read_bundles(spark, path).where("record_type = 'response'").collect()}
    assert bytes(payloads["9"]) == big.encode() and bytes(payloads["7"]) == b"z" * 700_000
    (tmp_path / "bundles" / "bundle-stray.warc.zst").write_bytes(b"left by a lost attempt")
    assert warc.read_bundles(spark, path).count() == len(rows)
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_second_write_keeps_or_replaces_the_first(spark, tmp_path):
    path = f"file://{tmp_path}/more"

    def pages(*ids):
        return warc.records(spark.createDataFrame([(i, "u", f"page {i}") for i in ids], "page_id long, url string, html string"))

    warc.write_bundles(pages(1, 2), path)
    warc.write_bundles(pages(3), path)
    assert sorted(r["record_id"] for r in warc.read_bundles(spark, path).collect()) == ["1", "2", "3"]
    warc.write_bundles(pages(4), path, mode="overwrite")
    assert [r["record_id"] for r in warc.read_bundles(spark, path).collect()] == ["4"]
    assert len(list((tmp_path / "more").glob("*.zst"))) == 1


def test_bundle_is_plain_zstandard_and_seekable():
    sink = stdio.BytesIO()
    sink.close = lambda: None
    writer = warc.BundleWriter(sink, frame_bytes=500)
    rows = [{"record_id": str(i), "record_type": "response", "target_uri": "u", "payload_digest": hashlib.sha1(b"p" * i).hexdigest(), "payload_bytes": i, "refers_to": None, "payload": b"p" * i} for i in range(0, 900, 100)]
    for r in rows:
        writer.add(r["record_id"], warc.encode_record(r))
    writer.close()
    raw = sink.getvalue()
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert whole == b"".join(warc.encode_record(r) for r in rows)

    class Source(stdio.BytesIO):
        def size(self):
            return len(raw)

    reader = warc.BundleReader(Source(raw))
    assert len(reader.sizes) > 3 and [r["payload_bytes"] for r in reader] == list(range(0, 900, 100))
    assert reader.find("700")[0]["payload"] == b"p" * 700 and reader.find("x") == []
    with pytest.raises(ValueError, match="digest"):
        warc.decode_record(warc.encode_record(rows[3]).replace(b"ppp", b"qpp", 1))


# ---- audio


def tunes(n=60, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, 64))
    vectors = [base[i % (n // 3)] + (0.0 if i < n // 3 else 0.03) * rng.normal(size=64) for i in range(n)]
    return [(i * 10, v.tolist()) for i, v in enumerate(vectors)]


def test_audio_search_finds_what_brute_force_finds(spark):
    prints = audio.fingerprints(audio.render(spark.createDataFrame(tunes(), "vec_id long, embedding array<double>")), "id", "media").collect()
    prints = {r["id"]: np.array(r["fingerprint"], np.int32).view(np.uint32) for r in prints}
    df = spark.createDataFrame([(i, p.view(np.int32).tolist()) for i, p in prints.items()], "id long, fingerprint array<int>")
    got = {(r["query_id"], r["match_id"]): r for r in audio.audio_search(df, df.where("id % 100 = 0")).collect()}
    want = {}
    for q in (i for i in prints if i % 100 == 0):
        for i in prints:
            rate, _, _, o, _ = best_offset(prints[q], prints[i])
            if i != q and rate / 32 <= audio.MOST_ERRORS:
                want[q, i] = rate / 32, o
    assert len(want) >= 8 and set(got) <= set(want) and len(set(got) & set(want)) >= 0.9 * len(want)
    for pair in set(got) & set(want):
        lead = (pair[1] % 7) - (pair[0] % 7)
        assert got[pair]["offset"] == want[pair][1] and got[pair]["error_rate"] == pytest.approx(want[pair][0]) and abs(got[pair]["offset"] - lead) <= 2


def best_offset(a, b):
    """The least (share of differing bits, -overlap, distance, offset) over all offsets, by comparing at each."""
    tried = []
    for o in range(1 - len(a), len(b)):
        wrong, n = audio.errors(a, b, o)
        if n >= audio.LEAST_OVERLAP * min(len(a), len(b)):
            tried.append((wrong / n, -n, abs(o), o, wrong))
    return min(tried)


def test_align_is_exact_at_every_offset():
    rng = np.random.default_rng(11)
    for _ in range(40):
        a = rng.integers(0, 1 << 32, rng.integers(1, 60), dtype=np.uint32)
        b = np.concatenate([rng.integers(0, 1 << 32, rng.integers(0, 30), dtype=np.uint32), a ^ (rng.random(len(a)) < 0.3).astype(np.uint32), a[: rng.integers(0, len(a))]])
        rate, n, _, o, wrong = best_offset(a, b)
        assert audio.align(a, b) == (o, audio.votes_at(a, b, o), -n, wrong)
        assert audio.align(a, ~a) is None or len(a) > 1
    assert audio.align(a, a[:0]) is None


def test_recall_against_brute_force_on_many_recordings(spark):
    df = audio.fingerprints(audio.render(spark.createDataFrame(tunes(1500, seed=4), "vec_id long, embedding array<double>")), "id", "media")
    prints = {r["id"]: np.array(r["fingerprint"], np.int32).view(np.uint32) for r in df.collect()}
    queries = [i for i in prints if i % 300 == 0]
    got = {(r["query_id"], r["match_id"]): (r["offset"], r["overlap"], r["bit_errors"]) for r in audio.audio_search(df, df.where("id % 300 = 0")).collect()}
    want = {(q, i): (x[0], x[2], x[3]) for q in queries for i in prints if i != q and (x := audio.align(prints[q], prints[i]))}
    # whatever shares a bin of keys is compared at every offset, so what is found is exact
    assert len(want) >= 90 and set(got) <= set(want) and len(got) >= 0.9 * len(want) and all(got[p] == want[p] for p in got)


def test_steady_tones_are_short_runs():
    t = np.arange(20 * 4000) / 4000
    hum = audio.fingerprint(audio.chroma(np.sin(2 * np.pi * 440 * t), 4000))
    keys, places, lengths = audio.key_runs(hum)
    assert len(keys) < 40 and audio.align(hum, hum[104:])[2] == len(hum) - 104


def test_matches_by_recording_equal_the_pairs(spark):
    vectors = tunes(30)
    vectors += [(7 + 700 * k, vectors[0][1]) for k in range(1, 6)] + [(5000, vectors[0][1]), (9800, vectors[0][1]), (16800, vectors[0][1]), (20_000, [float("nan")] * 64), (20_001, [1.0, float("nan"), None] * 30), (None, vectors[0][1])]
    prints = audio.fingerprints(audio.render(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")), "id", "media")
    pairs = defaultdict(list)
    for r in audio.audio_search(prints, prints.where("id % 20 = 0")).collect():
        pairs[r["match_id"]].append(r)
    rows = audio.matches_by_recording(prints, F.col("id") % 20 == 0).collect()
    assert len(rows) == len(vectors)
    for r in rows:
        mine = pairs.get(r["vec_id"], [])
        assert r["n_matches"] == len(mine) and (r["sum_query_ids"] or 0) == sum(p["query_id"] for p in mine)
        if mine:
            best = min(mine, key=lambda p: (p["error_rate"], p["query_id"]))
            assert all(r[c] == best[c] for c in ("query_id", "offset", "votes", "overlap", "bit_errors", "error_rate"))
        else:
            assert r["query_id"] is None
    assert audio.matches_by_recording(prints.limit(0), F.col("id") % 20 == 0).count() == 0


def test_odd_media_match_nothing(spark):
    good = spark.createDataFrame(tunes(24), "vec_id long, embedding array<double>")
    media = audio.render(good).unionByName(spark.createDataFrame([(1000, None), (1001, b""), (1002, b"RIFFxxxxWAVE"), (None, b"x"), (1003, audio.encode_wav(np.zeros(9000), 4000)), (1004, audio.encode_wav(np.zeros(3), 4000))], "id long, media binary"))
    prints = audio.fingerprints(media, "id", "media")
    sizes = {r["id"]: len(r["fingerprint"]) for r in prints.collect()}
    assert sizes[1000] == sizes[1001] == sizes[1002] == sizes[1004] == 0 and sizes[1003] > 0
    one = sorted(audio.audio_search(prints, prints.where("id % 20 = 0 or id > 999")).collect())
    assert one and not any(x > 999 for r in one for x in (r["query_id"], r["match_id"]))
    assert audio.audio_search(prints.limit(0), prints.limit(0)).count() == 0


def test_wav_formats():
    x = np.sin(np.arange(400) / 5)
    back, rate = audio.decode_wav(audio.encode_wav(x, 8000))
    assert rate == 8000 and np.allclose(back, x, atol=1e-3)
    stereo = bytearray(audio.encode_wav(np.repeat(x, 2), 8000))
    stereo[22:24] = (2).to_bytes(2, "little")
    assert np.allclose(audio.decode_wav(bytes(stereo))[0], x, atol=1e-3)
    assert audio.decode_wav(b"junk") is None and audio.decode_wav(None) is None


def test_areas_are_rectangle_sums():
    rng = np.random.default_rng(1)
    frames = rng.random((20, 12))
    got = audio.fingerprint(frames)
    wide = np.concatenate([frames, frames], axis=1)
    for t in range(len(got)):
        value = 0
        for kind, p, h, w in audio.FILTERS:
            box = wide[t : t + w, p : p + h]
            mask = np.zeros((w, h), dtype=bool)
            if kind in (0, 2):
                mask[: w // 2, : h if kind == 0 else h // 2] = True
            if kind == 1:
                mask[:, : h // 2] = True
            if kind == 2:
                mask[w // 2 :, h // 2 :] = True
            if kind == 3:
                mask[w // 4 : w - w // 4] = True
            ratio = np.log((1 + box[mask].sum()) / (1 + box[~mask].sum()))
            value = value << 2 | [0, 1, 3, 2][sum(ratio > b for b in audio.LEVELS)]
        assert value == got[t]


# ---- pipeline and registration


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns, name
        rows, kept = {r["doc_id"]: r for r in before.collect()}, after.collect()
        assert all(r == rows[r["doc_id"]] for r in kept)
        if name == "exact_dedup":
            assert len({r["text"] for r in kept}) == len(kept) == len({r["text"] for r in rows.values()})
            last = {}
            for i in sorted(rows):
                last[rows[i]["text"]] = i
            assert {r["doc_id"] for r in kept} == set(last.values())
        if name == "near_dedup":
            want = brute_components([(i, r["text"]) for i, r in rows.items()], 5, 80)
            assert {r["doc_id"] for r in kept} == {top for _, top in want.values()}
        before = spark.createDataFrame(kept, docs.schema)
    out = corpus_pipeline.run(spark, sf).collect()
    assert len(out) == before.count() and all(r["round_trip"] for r in out)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name


def test_pipeline_gives_every_segmentation(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "the cat sat"), (2, None)], "doc_id long, text string")
    rows = corpus_pipeline.sentencepiece(spark, docs, "").collect()
    assert len(rows) == 2 and all(len(s["ids"]) == s["n_tokens"] for r in rows for s in r["samples"]) and all(len(r["ids"]) == r["n_tokens"] for r in rows)


def test_every_operator_is_registered():
    from kinweave.llm import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11)) and set(queries.SQL) <= set(queries.QUERIES)
