"""Toxicity, quality, token counts and segmentations against brute force and edge cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinweave.llm import bytetext as bt
from kinweave.llm import quality, segmentation, token_counts, toxicity

ODD = [None, "", "   ", "a", "The THE the", "naïve café\u0301 ΑΣ İ ß", "日本語 テスト", "x<|endoftext|>y", "it's we'll 1234 ½² ...!!", "\u00a0tab\tnew\nline\x1c\x85", "w" * 5000, "word " * 20000]


def odd_docs(spark):
    rows = [(i, t, "en", 1.0, "clash") for i, t in enumerate(ODD)] + [(3, "a", "en", 1.0, "clash"), (None, "null id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, N_Tokens string")


def labels_of(spark, rows, column):
    return spark.createDataFrame(rows, f"doc_id long, {column} int")


def test_words_and_shingles_equal_plain_python():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \t\nÉéZ\x0b.") for _ in range(rng.randrange(60))) for _ in range(200)] + ["", "x", "A b"]
    data, offsets = bt.buffers(pa.array(texts))
    hashes, cut = bt.words(data, offsets)
    words = [t.encode().lower().split() for t in texts]
    assert np.diff(cut).tolist() == [len(w) for w in words]
    seen = {}
    for h, w in zip(hashes.tolist(), [w for ws in words for w in ws], strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    for width in (3, 5):
        for s, w in zip(bt.shingle_sets(data, offsets, width), words, strict=True):
            want = {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
            assert len(s) == len(want) and (np.diff(s.astype(object)) > 0).all()


def test_segments_do_not_change_hashes(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000))
    data, offsets = bt.buffers(pa.array([text]))
    whole, _ = bt.words(data, offsets)
    monkeypatch.setattr(bt, "SEGMENT", 100)
    assert (bt.words(data, offsets)[0] == whole).all()


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = token_counts.token_counts(odd_docs(spark), path, limit=3).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        text = "null id" if r["doc_id"] is None else ODD[r["doc_id"]] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 3)
    assert token_counts.token_counts(odd_docs(spark).limit(0), path).count() == 0


def test_plain_texts_are_split_as_the_library_does():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, words = Tokenizer.from_file(path), token_counts.lengths(path)
    letters = "abcXYZ 019'’.,!?-_\t\n\r" + "".join(chr(c) for c in range(0xA0, 0x180)) + "$½²ªº"
    rng = random.Random(4)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(2000)]
    table = token_counts.Table({"a": words["a"], "'s": words["'s"], "0": words["0"]})
    for text, n in zip(texts, token_counts.counts(texts, table, words), strict=True):
        assert n == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    assert token_counts.counts(["", "a b"], token_counts.Table({}), words) == [0, words["a"] + words["b"]]


def test_cache_forgets_but_stays_right(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 10)
    words = token_counts.WordLengths(token_counts.lengths(path).tokenizer)
    want = {w: len(words.tokenizer.encode(w, add_special_tokens=False).ids) for w in (f"word{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(60))}
    assert all(words[w] == n for w, n in want.items()) and len(words) <= 12


def classifier_docs(spark, seed=1, n=300):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randrange(40)) for _ in range(rng.randrange(8, 30))]
        if bad:
            for w in rng.sample(["vile", "nasty", "rotten"], 2):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words), "en", "s", 1))
        if i % 3:
            labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), labels_of(spark, labels, "toxic"), {i: y for i, y in labels}


def test_neighbours_are_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    monkeypatch.setattr(toxicity, "FIRST_BLOCKS", 1)
    rng = np.random.default_rng(3)
    idf = rng.uniform(1, 5, 20)
    vectors = []
    for _ in range(60):
        t = np.sort(rng.choice(20, rng.integers(1, 6), replace=False))
        vectors.append((t, rng.integers(1, 5, len(t))))
    owner, term, counts = np.repeat(np.arange(60), [len(t) for t, _ in vectors]), np.concatenate([t for t, _ in vectors]), np.concatenate([c for _, c in vectors])
    texts = np.arange(60) // 2  # two examples of each text
    index = toxicity.BlockMaxIndex.build(rng.integers(0, 2, 60), texts, owner, term, counts, idf, 0.1)
    dense = np.zeros((60, 20))
    for i, (t, c) in enumerate(vectors):
        dense[i, t] = index.unit(t, c)
    for q in range(60):
        t, c = vectors[q]
        cosines, examples = index.nearest(t, index.unit(t, c), k=7, text=q // 2)
        sims = dense @ dense[q]
        sims[texts == q // 2] = -1
        want = np.sort(sims[sims > 1e-12])[::-1][:7]
        assert np.allclose(cosines, want) and np.allclose(sims[examples], cosines)


def test_vocabulary_finds_what_it_holds():
    rng = np.random.default_rng(9)
    for n in (0, 1, 2, 300, 5000):
        known = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        asked = np.concatenate([rng.permutation(known), rng.integers(0, 1 << 64, 400, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)])
        at, k = toxicity.Vocabulary(known).find(asked)
        assert (known[k] == asked[at]).all() and len(at) == np.isin(asked, known).sum()


def test_word_hashes_tell_thue_morse_words_apart():
    for n in (1024, 4096):
        data, offsets = bt.buffers(pa.array([thue_morse(n), thue_morse(n, 1)]))
        a, b = bt.words(data, offsets)[0]
        assert a != b


def test_toxicity_depends_on_the_text_alone(spark):
    docs, labels, known = classifier_docs(spark)
    moved = docs.withColumn("doc_id", F.col("doc_id") + 100_000).withColumns({"lang": F.lit("xx"), "source": F.lit("other")})
    rows = toxicity.toxicity(docs.unionByName(moved), labels).collect()
    scores = {r["doc_id"]: r["score"] for r in rows}
    assert len(rows) == 600 and all(scores[i] == scores[i + 100_000] for i in range(300))


@pytest.mark.parametrize("kind", ["smallint", "decimal(12,0)", "string", "binary"])
def test_toxicity_with_any_id_type(spark, kind):
    docs, labels, known = classifier_docs(spark, n=120)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("string").cast(kind))
    labels = labels.withColumn("doc_id", F.col("doc_id").cast("string").cast(kind))
    got = toxicity.toxicity(docs, labels)
    assert dict(got.dtypes)["doc_id"] == kind and got.count() == 120
    assert toxicity.without_toxic(docs, labels).schema == docs.schema


def test_without_toxic_judges_rows_not_ids(spark):
    docs, labels, known = classifier_docs(spark)
    bad, clean = "alpha1 vile nasty beta2 rotten gamma3 vile nasty", "alpha1 beta2 gamma3 delta4 omega5 alpha6"
    extra = [(None, bad), (None, clean), (900, bad), (900, clean), (901, None), (901, "")]
    more = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in extra], docs.schema)
    kept = toxicity.without_toxic(docs.unionByName(more), labels).collect()
    assert [(r["doc_id"], r["text"]) for r in kept if (r["doc_id"], r["text"]) in extra] == [e for e in extra if e[1] != bad]


def test_repeated_label_ids_teach_the_same_text_each_time(spark):
    docs, labels, known = classifier_docs(spark)
    twice = docs.unionByName(docs.where("doc_id < 60").withColumn("text", F.concat(F.lit("another rotten "), "text")))
    runs = [sorted((r["doc_id"], r["score"]) for r in op(twice.repartition(n), labels).collect()) for n in (2, 5) for op in (toxicity.toxicity,)]
    assert runs[0] == runs[1]
    ratings = labels.withColumnRenamed("toxic", "quality")
    runs = [sorted((r["doc_id"], r["score"]) for r in quality.quality(twice.repartition(n), ratings).collect()) for n in (2, 5)]
    assert runs[0] == runs[1]


def test_training_texts_are_bounded(spark):
    docs = spark.createDataFrame([(i, "word " * 200) for i in range(50)], "doc_id long, text string")
    marks = labels_of(spark, [(i, i % 2) for i in range(50)], "toxic")
    n = quality.labelled(docs, marks, "toxic", "doc_id", "text", 40, train_bytes=16_000).count()
    assert n == 16 and quality.labelled(docs, marks, "toxic", "doc_id", "text", 40).count() == 40


def test_toxicity_holds_out_and_separates(spark):
    docs, labels, known = classifier_docs(spark)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 300
    held = [i for i in known if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i in held) and not any(r["held_out"] for i, r in got.items() if zlib.crc32(str(i).encode()) % 4 != 2)
    assert all((got[i]["score"] >= 0.3) == bool(known[i]) == bool(got[i]["predicted"]) for i in held)
    for i, r in got.items():
        assert 0 <= r["score"] <= 1 and i not in [e["doc_id"] for e in r["evidence"]]
        assert all(e["doc_id"] not in held for e in r["evidence"])
    # labels of the held-out fold change nothing
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, flipped).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


@pytest.mark.parametrize("rows", [[], [(0, 0), (4, 0)], [(0, 1), (None, 1), (4, None)]])
def test_toxicity_and_quality_without_both_labels(spark, rows):
    got = toxicity.toxicity(odd_docs(spark), labels_of(spark, rows, "toxic")).collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in got)
    got = quality.quality(odd_docs(spark), labels_of(spark, rows, "quality")).collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in got)


def test_without_toxic_keeps_columns(spark):
    docs, labels, known = classifier_docs(spark)
    kept = toxicity.without_toxic(docs.withColumn("score", F.lit("clash")), labels)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == [*docs.columns, "score"]
    assert not any(known.get(i) for i in ids) and all(i in ids for i, y in known.items() if not y)
    assert toxicity.without_toxic(docs.limit(0), labels).count() == 0


def test_quality_learns_repetition_and_junk(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        words = [f"{rng.choice('bdfgklm')}{rng.choice('aeiou')}{rng.choice('nrst')}{rng.randrange(30)}" for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            words = [words[0]] * 30 if i % 8 else [w + "%%%" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.quality(docs, labels_of(spark, labels, "quality")).where("held_out").collect()
    truth = dict(labels)
    assert len(got) > 40 and all((r["score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in got)


def test_ftrl_matches_a_plain_loop():
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(16, 4, replace=False)).astype(np.int32), rng.random(4).astype(np.float32), int(rng.integers(0, 2))) for _ in range(50)]
    model = quality.train_ftrl(rows, bits=4, epochs=1)
    z, n, zb, nb = [0.0] * 16, [0.0] * 16, 0.0, 0.0
    a, b, l1, l2 = 0.3, 1.0, 0.05, 1.0
    w = lambda i: 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((b + n[i] ** 0.5) / a + l2)
    for at, x, y in rows:
        bias = -zb / ((b + nb**0.5) / a)
        p = 1 / (1 + math.exp(-(sum(w(i) * v for i, v in zip(at.tolist(), x.tolist())) + bias)))
        for i, v in zip(at.tolist(), x.tolist()):
            g, wi = (p - y) * v, w(i)
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / a * wi
            n[i] += g * g
        g = p - y
        zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / a * bias
        nb += g * g
    assert np.allclose(model.weights, [w(i) for i in range(16)], atol=1e-5)


PIECES = public_tokenizers.path("piece_bpe_32k.model")


def all_segmentations(m, text):
    """Every split of the normalised text into pieces (bytes for characters outside), with its weight."""
    raw = b" " + text.encode()
    pieces = {m.bytes[m.offsets[i] : m.offsets[i + 1]].tobytes(): i for i in range(len(m.lengths)) if np.isfinite(m.logp[i]) and m.lengths[i]}
    out = {}

    def grow(at, ids, logp):
        if at == len(raw):
            out[tuple(ids)] = logp
            return
        n = 1
        while at + n < len(raw) and raw[at + n] & 0xC0 == 0x80:
            n += 1
        if raw[at : at + n] not in pieces:
            grow(at + n, ids + [m.first_byte + b for b in raw[at : at + n]], logp + n * m.byte_logp)
        for end in range(at + 1, len(raw) + 1):
            if raw[at:end] in pieces:
                i = pieces[raw[at:end]]
                grow(end, [*ids, i], logp + m.logp[i])

    grow(0, [], 0.0)
    total = np.logaddexp.reduce(list(out.values()))
    return {k: v - total for k, v in out.items()}


@pytest.mark.parametrize("text", ["thes", "a", "an ox", "né\n", "the  a"])
def test_samples_are_distinct_and_come_by_the_exact_law(text):
    m = segmentation.model(PIECES)
    law = all_segmentations(m, text)
    n, k = 4000, 2
    data, offsets = bt.buffers(pa.array([text] * n))
    keys = bt.mix(np.array([segmentation.key_of(i, 0) for i in range(n)], np.uint64))
    found = segmentation.sample_texts(m, data, offsets, keys, k)
    first, included = Counter(), Counter()
    for samples in found:
        ids = [tuple(s.ids.tolist()) for s in samples]
        assert len(set(ids)) == len(ids) == min(k, len(law)) and samples[0].gumbel >= samples[-1].gumbel
        for i, s in zip(ids, samples, strict=True):
            assert s.logp == pytest.approx(law[i], abs=1e-6) and s.log_inclusion <= 1e-9
            included[i] += 1
        first[ids[0]] += 1
    p = {i: math.exp(v) for i, v in law.items()}
    for i, v in p.items():
        assert abs(first[i] / n - v) < 4 * math.sqrt(v * (1 - v) / n) + 1e-3
        both = v + sum(p[j] * v / (1 - p[j]) for j in p if j != i and p[j] < 1)
        if len(law) > k:
            assert abs(included[i] / n - both) < 4 * math.sqrt(both * (1 - min(both, 1)) / n) + 2e-3
    if len(law) > k:
        weights = [sum(math.exp(s.logp - s.log_inclusion) for s in samples) for samples in found]
        assert np.mean(weights) == pytest.approx(1, abs=0.03)


def test_all_segmentations_of_a_short_text_come_once():
    m = segmentation.model(PIECES)
    law = all_segmentations(m, "ox")
    data, offsets = bt.buffers(pa.array(["ox"]))
    samples = segmentation.sample_texts(m, data, offsets, bt.mix(np.array([1], np.uint64)), 20)[0]
    kept = list(law)
    assert {tuple(s.ids.tolist()) for s in samples} >= set(kept) and len({tuple(s.ids.tolist()) for s in samples}) == len(samples)


def test_segment_round_trips_and_repeats(spark):
    m = segmentation.model(PIECES)
    df = segmentation.segment(odd_docs(spark), PIECES, k=2, with_sample_ids=True)
    a, b = (sorted(((r["doc_id"] is None, r["doc_id"] or 0), r) for r in df.repartition(n).collect()) for n in (1, 3))
    assert a == b and len(a) == len(ODD) + 2
    for _, r in a:
        text = "null id" if r["doc_id"] is None else ODD[r["doc_id"]] or ""
        assert r["ids"] == m.library.encode(text) and r["n_tokens"] == len(r["ids"]) and r["round_trip"]
        assert r["ids_crc"] == zlib.crc32(np.array(r["ids"], "<i4").tobytes())
        assert 1 <= len(r["samples"]) <= 2 and all(m.decode(s["ids"]) == text for s in r["samples"])
    assert segmentation.segment(odd_docs(spark).limit(0), PIECES).count() == 0


def test_decode_column(spark):
    df = segmentation.segment(odd_docs(spark), PIECES)
    got = segmentation.decode(df, PIECES).collect()
    assert all(r["text"] == ("null id" if r["doc_id"] is None else ODD[r["doc_id"]] or "") for r in got)
    lossy = spark.createDataFrame([(1, "a▁b")], "doc_id long, text string")
    assert [r["round_trip"] for r in segmentation.segment(lossy, PIECES).collect()] == [False]


def test_every_segmentation_is_found_however_unlikely():
    m = segmentation.model(PIECES)
    for text in ("the", "of the", "né,x\n"):
        law = all_segmentations(m, text)
        data, offsets = bt.buffers(pa.array([text]))
        samples = segmentation.sample_texts(m, data, offsets, bt.mix(np.array([3], np.uint64)), 200)[0]
        assert {tuple(s.ids.tolist()): pytest.approx(s.logp) for s in samples} == law and len(samples) == len(law)
        assert all(s.log_inclusion == 0 for s in samples)


def thue_morse(n, flip=0):
    return "".join("ab"[(bin(i).count("1") + flip) & 1] for i in range(n))


def test_encoding_is_the_library_s_on_odd_texts():
    rng = random.Random(5)
    parts = ["a", "the", "▁", " ", "  ", "é", "\n", "\t", "日", "x▁", "▁ ", "of", "▁▁", "1", "🙂", "\x00", "\x7f", "of,", "..", "don't"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)]
    # words that polynomial hashes modulo 2^64 can't tell apart
    texts += [thue_morse(1024) + " " + thue_morse(1024, 1), thue_morse(2048, 1) + " " + thue_morse(2048), "z" * 30_000, "日" * 9000]
    m = segmentation.model(PIECES)
    data, offsets = bt.buffers(pa.array(texts))
    ids, at, same = segmentation.encode_texts(m, data, offsets)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == m.library.encode(t)
        assert same[i] == ("▁" not in t)
    long = segmentation.sample_texts(m, data, offsets, bt.mix(np.arange(len(texts), dtype=np.uint64)), 2)[-4:]
    assert [len(x) for x in long] == [2, 2, 2, 1] and all(m.decode(s.ids) == t for x, t in zip(long, texts[-4:], strict=True) for s in x)


def test_samples_don_t_depend_on_the_batch(monkeypatch):
    m = segmentation.model(PIECES)
    texts = ["the cat, sat", "of the moron", "", "né e", "the cat, sat"] * 20
    data, offsets = bt.buffers(pa.array(texts))
    keys = bt.mix(np.arange(len(texts), dtype=np.uint64))
    whole = segmentation.sample_texts(m, data, offsets, keys, 3)
    monkeypatch.setattr(segmentation, "KEPT_EDGES", 0)
    for i in range(0, len(texts), 7):
        d, o = bt.buffers(pa.array(texts[i : i + 1]))
        (alone,) = segmentation.sample_texts(m, d, o, keys[i : i + 1], 3)
        assert [(s.ids.tolist(), s.logp, s.gumbel, s.log_inclusion) for s in alone] == [(s.ids.tolist(), s.logp, s.gumbel, s.log_inclusion) for s in whole[i]]


def test_keys_have_64_bits():
    assert len({segmentation.key_of(f"doc-{i}", 0) for i in range(1_000_000)}) == 1_000_000
    assert segmentation.key_of("doc-208744841", 0) != segmentation.key_of("doc-880679910", 0) and segmentation.key_of(1, 0) != segmentation.key_of(1, 7)


def test_full_cache_keeps_the_chunks_of_most_batches(monkeypatch):
    m = segmentation.Model(PIECES)
    texts = ["the cat, sat on a mat né", *[f"the cat, w{i}x{i * i} 日{i} sat on é{i}" for i in range(60)]]
    want = {}
    for limit in (1 << 30, 150, 0):
        monkeypatch.setattr(segmentation, "KEPT_EDGES", limit)
        m.chunks.clear()
        for i, text in enumerate(texts):
            data, offsets = bt.buffers(pa.array([text]))
            split = segmentation.split_texts(m, data, offsets)
            ids, _, same = segmentation.encode_texts(m, data, offsets, split)
            (samples,) = segmentation.sample_texts(m, data, offsets, bt.mix(np.array([i], np.uint64)), 3, split)
            got = (ids.tolist(), same.tolist(), [(s.ids.tolist(), s.logp, s.gumbel, s.log_inclusion) for s in samples])
            assert got == want.setdefault(i, got) and got[0] == m.library.encode(text) and same.all()
        if limit == 150:
            m.chunks.forget()
            assert {b" cat", b" the"} <= set(m.chunks.place) and len(m.chunks.dst) <= 75


def test_decoding_is_of_whole_texts():
    m = segmentation.model(PIECES)
    texts = ["", "the cat", "né,x\n", "🙂\x00 of"]
    data, offsets = bt.buffers(pa.array(texts))
    ids, at, same = segmentation.encode_texts(m, data, offsets)
    assert same.all() and segmentation.decodes_to(m, ids, at, data, offsets).all()
    for k in range(len(ids)):
        other = ids.copy()
        other[k] = m.first_byte + ord("~")
        got = segmentation.decodes_to(m, other, at, data, offsets)
        owner = int(np.searchsorted(at, k, side="right")) - 1
        assert got.tolist() == [i != owner for i in range(len(texts))]


def test_query_gives_every_segmentation(spark):
    from kinweave.llm import queries

    m = segmentation.model(PIECES)
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op2_sentencepiece(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        for ids, crc, n in [(r["ids"], r["ids_crc"], r["n_tokens"]), *[(s["ids"], s["ids_crc"], s["n_tokens"]) for s in r["samples"]]]:
            assert len(ids) == n and zlib.crc32(np.array(ids, "<i4").tobytes()) == crc and m.decode(ids) == docs[r["doc_id"]]


def test_worker_keeps_one_operator_s_caches():
    from kinweave.llm import common

    segmentation.model(PIECES)
    common.drop_kept("segmentation")
    assert PIECES in segmentation._models
    common.drop_kept()
    assert not segmentation._models
