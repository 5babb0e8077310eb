"""Media columns: chroma fingerprints of audio and their alignment (operator 5).

A recording is a binary column of WAV bytes. Its spectrum is folded into twelve
pitch classes a frame; an integral image of the frames lets each of sixteen
filters compare rectangles in four reads, and two bits a filter, Gray-coded,
pack a window of frames into one 32-bit integer. Two recordings align at an
offset where their integers agree.

A search is a join on keys. A key is an integer together with the one a window
later, so it hears twice the window and is seldom shared by chance; equal
neighbours are one run, so a steady tone is one row. Recordings that share keys
vote in a histogram of offsets; a pair with a bin of ``LEAST_VOTES`` is compared
at every offset there is: the bits' cross-correlation gives the differing bits
of all offsets at once, and the least share of them decides. Equal fingerprints
are one class throughout.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table, unused

FRAME_SECONDS, HOP_SECONDS = 0.064, 0.032
LOW_HZ, HIGH_HZ = 100.0, 1900.0
#: Frames that one integer sees.
WINDOW = 8
#: Bounds of a filter's four levels, in log ratio.
LEVELS = (-0.35, 0.0, 0.35)
#: Shared keys in one bin of offsets that make a candidate, and offsets in a bin (a power of two).
LEAST_VOTES = 2
BIN = 16
#: Frames of two runs together above which they make a candidate alone, without listing their bins.
LONG_RUNS = 64
#: A key with more runs in a fingerprint (a periodic sound) counts as one long run.
REPEATS = 8
#: Overlap a match needs, as a share of the shorter recording; share of bits that may differ.
LEAST_OVERLAP = 0.5
MOST_ERRORS = 0.15


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, pitch, height, width) of sixteen filters, from a rule: four kinds by four bands, widths in turn."""
    return [(kind, (3 * band + kind) % 12, (4, 6, 3, 5)[band], (WINDOW, 6, 4, WINDOW)[(kind + band) % 4]) for kind in range(4) for band in range(4)]


FILTERS = _filters()
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """16-bit mono PCM of samples in [-1, 1]."""
    body = (np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def decode_wav(data: bytes | None) -> tuple[np.ndarray, int] | None:
    """(mono samples, rate) of PCM with 8, 16, 24 or 32 bits; None where the bytes are no such file."""
    if not data or len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            form = struct.unpack("<HHIIHH", body[:16])
        elif name == b"data" and form is not None:
            kind, channels, rate, _, _, bits = form
            if kind not in (1, 0xFFFE) or bits not in (8, 16, 24, 32) or not channels or not rate:
                return None
            width = bits // 8
            raw = np.frombuffer(body[: len(body) // (width * channels) * width * channels], np.uint8)
            if bits == 8:
                x = raw.astype(np.float32) / 128 - 1
            elif bits == 24:
                b = raw.reshape(-1, 3).astype(np.int32)
                x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) / 2.0**31).astype(np.float32)
            else:
                x = np.frombuffer(raw.tobytes(), f"<i{width}").astype(np.float32) / np.float32(2 ** (bits - 1))
            return x.reshape(-1, channels).mean(axis=1), rate
        at += 8 + size + size % 2
    return None


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Unit vectors of twelve pitch classes a frame; silent frames are zero."""
    size, hop = max(int(rate * FRAME_SECONDS), 2), max(int(rate * HOP_SECONDS), 1)
    frames = (len(samples) - size) // hop + 1
    if frames < 1:
        return np.zeros((0, 12))
    freq = np.fft.rfftfreq(size, 1 / rate)
    band = np.flatnonzero((freq >= LOW_HZ) & (freq <= HIGH_HZ))
    pitch = 12 * np.log2(freq[band] / 440.0)
    fold = np.zeros((len(band), 12))
    whole = np.floor(pitch).astype(int)
    fold[np.arange(len(band)), whole % 12] += 1 - (pitch - whole)
    fold[np.arange(len(band)), (whole + 1) % 12] += pitch - whole
    taper, out = np.hanning(size), []
    view = np.lib.stride_tricks.sliding_window_view(samples, size)[::hop]
    for at in range(0, frames, 2048):  # bounded memory for long recordings
        power = np.abs(np.fft.rfft(view[at : at + 2048] * taper, axis=1)[:, band]) ** 2
        out.append(power @ fold)
    energy = np.concatenate(out)
    norm = np.linalg.norm(energy, axis=1, keepdims=True)
    return np.where(norm > 1e-6, energy / np.maximum(norm, 1e-30), 0.0)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """One integer for each window of frames."""
    n = len(frames) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    wide = np.concatenate([frames, frames], axis=1)  # pitch classes wrap around
    image = np.zeros((len(frames) + 1, 25))
    image[1:, 1:] = wide.cumsum(axis=0).cumsum(axis=1)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[t1 : t1 + n, p1] - image[t0 : t0 + n, p1] - image[t1 : t1 + n, p0] + image[t0 : t0 + n, p0]

    out = np.zeros(n, np.uint32)
    for kind, p, h, w in FILTERS:
        t, q = w // 2, p + h // 2
        whole = area(0, w, p, p + h)
        if kind == 0:
            a = area(0, t, p, p + h)
        elif kind == 1:
            a = area(0, w, p, q)
        elif kind == 2:
            a = area(0, t, p, q) + area(t, w, q, p + h)
        else:
            a = area(w // 4, w - w // 4, p, p + h)
        value = np.log((1 + np.maximum(a, 0)) / (1 + np.maximum(whole - a, 0)))
        level = sum((value > b).astype(np.int64) for b in LEVELS)
        out = out << np.uint32(2) | _GRAY[level]
    return out


_SILENCE = int(fingerprint(np.zeros((WINDOW, 12)))[0])
_SILENCE_INT = int(np.uint32(_SILENCE).astype(np.int32))


def fingerprints(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """``id, fingerprint`` of every recording; null, broken and too short ones have an empty list."""
    kind = media.schema[id_col].dataType.simpleString()
    i, m = unused(media, "x_id", "x_media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(1):
                found = decode_wav(data.as_py())
                out.append([] if found is None else fingerprint(chroma(*found)).view(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["id", "fingerprint"])

    return media.select(F.col(id_col).alias(i), F.col(media_col).alias(m)).mapInArrow(run, f"id {kind}, fingerprint array<int>")


def key_runs(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first place, length) of each run of equal keys; silence is no key.

    A key of more than ``REPEATS`` runs is one row of more than ``LONG_RUNS``
    frames: it makes a candidate wherever it is shared, so nothing is lost and
    a fingerprint has a bounded number of rows a key.
    """
    n = len(prints) - WINDOW
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = prints[:n].astype(np.uint64) << np.uint64(32) | prints[WINDOW:]
    heard = (prints[:n] != _SILENCE) & (prints[WINDOW:] != _SILENCE)
    edge = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (heard[1:] != heard[:-1])))
    length = np.diff(np.append(edge, n))
    kept = heard[edge]
    keys, place, length = keys[edge][kept], edge[kept], length[kept]
    _, first, which, times = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    length = np.where(times[which] > REPEATS, LONG_RUNS + 1, length)
    kept = np.ones(len(keys), dtype=bool)
    kept[times[which] > REPEATS] = False
    kept[first] = True
    return keys[kept], place[kept], length[kept]


def votes_at(query: np.ndarray, recording: np.ndarray, offset: int) -> int:
    """Shared keys with the query ``offset`` frames into the recording."""
    a, b = query[max(0, -offset) :], recording[max(0, offset) :]
    n = min(len(a), len(b))
    same = (a[:n] == b[:n]) & (a[:n] != _SILENCE)
    return int((same[: n - WINDOW] & same[WINDOW:n]).sum()) if n > WINDOW else 0


def align(query: np.ndarray, recording: np.ndarray) -> tuple[int, int, int, int] | None:
    """(offset, votes, overlap, differing bits) of the offset with the least share of differing bits, of equal ones that of
    the larger overlap, the lesser distance, then the lesser; None unless it is at most ``MOST_ERRORS``.

    All offsets with an overlap of ``LEAST_OVERLAP`` of the shorter side are
    compared: with bits as signs, agreements less differences at every offset
    are one correlation, summed over the bits before it is transformed back.
    """
    n, m = len(query), len(recording)
    if not n or not m:
        return None
    size = 1 << (n + m - 1).bit_length()
    total = np.zeros(size // 2 + 1, np.complex128)
    for at in range(0, 32, 8):  # eight bits at once, for memory
        shift = np.arange(at, at + 8, dtype=np.uint32)[:, None]
        a, b = (((x[None, :] >> shift & np.uint32(1)).astype(np.float64) * 2 - 1) for x in (query, recording))
        total += (np.fft.rfft(b, size, axis=1) * np.fft.rfft(a, size, axis=1).conj()).sum(axis=0)
    offset = np.arange(1 - n, m)
    agree = np.rint(np.fft.irfft(total, size)[offset % size]).astype(np.int64)
    overlap = np.minimum(offset + n, m) - np.maximum(offset, 0)
    wrong = (32 * overlap - agree) // 2
    tried = np.flatnonzero((overlap >= LEAST_OVERLAP * min(n, m)) & (wrong <= MOST_ERRORS * 32 * overlap))
    if not len(tried):
        return None
    k = tried[np.lexsort((offset[tried], np.abs(offset[tried]), -overlap[tried], wrong[tried] / overlap[tried]))[0]]
    o = int(offset[k])
    return o, votes_at(query, recording, o), int(overlap[k]), int(wrong[k])


def errors(query: np.ndarray, recording: np.ndarray, offset: int) -> tuple[int, int]:
    """(differing bits, frames of overlap) with the query ``offset`` frames into the recording."""
    a, b = query[max(0, -offset) :], recording[max(0, offset) :]
    n = min(len(a), len(b))
    return int(np.bitwise_count(a[:n] ^ b[:n]).sum()) if n > 0 else 0, max(n, 0)


def _classes(prints: DataFrame) -> DataFrame:
    """``name, id, fingerprint`` of the recordings with keys to vote; equal fingerprints have equal names."""
    name = F.sha2(F.concat_ws(",", F.col("fingerprint").cast("array<string>")), 256)
    return prints.where(F.col("id").isNotNull() & (F.size("fingerprint") > WINDOW)).select(name.alias("name"), "id", "fingerprint")


def _runs(classes: DataFrame, side: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, keys, places, lengths = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            lists = batch.column(1)
            flat, at = lists.flatten().to_numpy().view(np.uint32), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
            for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                key, place, length = key_runs(flat[a:b])
                names.append(np.full(len(key), k))
                keys.append(key)
                places.append(place)
                lengths.append(length)
            owner = pa.array(np.concatenate([np.zeros(0, np.int64), *names]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), batch.column(0).take(owner), pa.array(np.concatenate(places), pa.int32()), pa.array(np.concatenate(lengths), pa.int32())], names=["key", "name", "place", "length"])

    return classes.select("name", "fingerprint").mapInArrow(run, "key long, name string, place int, length int").toDF("key", side, f"{side}_place", f"{side}_length")


def class_matches(queries: DataFrame, recordings: DataFrame) -> DataFrame:
    """``q, r, offset, votes, overlap, bit_errors, error_rate`` of the different fingerprints that align; both sides are ``name, fingerprint``, one row a name."""
    voters = _runs(queries, "q").join(_runs(recordings, "r"), "key").where(F.col("q") != F.col("r"))
    # the offsets at which two runs meet are an interval; runs that could fill a bin alone needn't list it
    least, short = F.least("q_length", "r_length"), F.col("q_length") + F.col("r_length") <= LONG_RUNS
    first, last = F.col("r_place") - F.col("q_place") - F.col("q_length") + 1, F.col("r_place") + F.col("r_length") - 1 - F.col("q_place")
    bins = F.when((least >= LEAST_VOTES) | ~short, F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.floor(first / BIN).cast("int"), F.floor(last / BIN).cast("int")))
    votes = voters.select("q", "r", F.explode(bins).alias("bin"), least.alias("n")).groupBy("q", "r", "bin").agg(F.sum("n").alias("n"))
    pairs = votes.where(F.col("bin").isNull() | (F.col("n") >= LEAST_VOTES)).select("q", "r").distinct()
    both = pairs.join(queries.select(F.col("name").alias("q"), F.col("fingerprint").alias("q_print")), "q").join(recordings.select(F.col("name").alias("r"), F.col("fingerprint").alias("r_print")), "r")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, found = [], []
            for k in range(batch.num_rows):
                a, b = (batch[c][k].values.to_numpy().view(np.uint32) for c in ("q_print", "r_print"))
                got = align(a, b)
                if got is not None:
                    keep.append(k)
                    found.append((*got, got[3] / (32 * got[2])))
            columns = list(zip(*found, strict=True)) or [()] * 5
            taken = batch.select(["q", "r"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, *[pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 4 + [pa.float64()], strict=True)]], names=["q", "r", "offset", "votes", "overlap", "bit_errors", "error_rate"])

    return both.select("q", "r", "q_print", "r_print").mapInArrow(compare, "q string, r string, offset int, votes int, overlap int, bit_errors int, error_rate double")


def _one_of_each(members: DataFrame) -> DataFrame:
    return members.groupBy("name").agg(F.any_value("fingerprint").alias("fingerprint"), F.count(F.lit(1)).alias("n"))


def _own(fingerprint: Column) -> list[Column]:
    """The alignment of a fingerprint with its equal: offset, votes, overlap, bit errors, error rate."""
    n = F.size(fingerprint)
    heard = F.transform(F.sequence(F.lit(1), n - WINDOW), lambda t: ((F.get(fingerprint, t - 1) != _SILENCE_INT) & (F.get(fingerprint, t + WINDOW - 1) != _SILENCE_INT)).cast("int"))
    votes = F.when(n > WINDOW, F.aggregate(heard, F.lit(0), lambda total, x: total + x)).otherwise(0)
    return [F.lit(0).alias("offset"), votes.alias("votes"), n.alias("overlap"), F.lit(0).alias("bit_errors"), F.lit(0.0).alias("error_rate")]


def audio_search(prints: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, match_id, offset, votes, overlap, bit_errors, error_rate`` of all recordings that align with a stated query.

    Both sides are :func:`fingerprints`; a recording isn't a match of its own
    id. The query starts ``offset`` frames into the match; ``votes`` counts the
    keys they share there. Fingerprints of up to ``WINDOW`` integers, empty
    ones too, and those that share fewer than ``LEAST_VOTES`` keys in a bin,
    like silence, match nothing. Null ids are left out; of a repeated id every
    row counts. The rows are all pairs of ids, so equal recordings multiply
    them; :func:`audio_matches` combines them by class.
    """
    members, asked = _classes(prints), _classes(queries)
    recordings = cut(_one_of_each(members), "recordings")
    wanted = cut(_one_of_each(asked), "queries")
    found = class_matches(wanted, recordings)
    own = wanted.select(F.col("name").alias("q"), F.col("name").alias("r"), *_own(F.col("fingerprint"))).where(F.col("votes") >= LEAST_VOTES)
    found = found.unionByName(own)
    rows = found.join(asked.select(F.col("name").alias("q"), F.col("id").alias("query_id")), "q").join(members.select(F.col("name").alias("r"), F.col("id").alias("match_id")), "r")
    return rows.where(F.col("query_id") != F.col("match_id")).select("query_id", "match_id", "offset", "votes", "overlap", "bit_errors", "error_rate")


RATE, NOTE = 4000, 256


def render(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, media``: each vector as a tune, one note a value, after a lead-in of silence that depends on the id.

    The fixtures hold no audio, so their vectors are heard: a value's standing
    among its vector's picks one of twelve pitches, and alike vectors give
    alike tunes at different offsets. Values that are null, NaN or infinite
    count as 0; null and empty vectors have no recording.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    wave = np.sin(2 * np.pi * 440.0 * 2 ** (np.arange(12) / 12)[:, None] * np.arange(NOTE) / RATE) * np.hanning(NOTE) * 0.8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # tunes are some 35 kB each
                part, out = batch.slice(at, 256), []
                for i, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    x = np.array([0.0 if y is None or not np.isfinite(y) else y for y in v or ()])
                    if not len(x):
                        out.append(None)
                        continue
                    z = (x - x.mean()) / (x.std() or 1.0)
                    notes = np.clip(np.floor(z * 3 + 6), 0, 11).astype(int)
                    lead = np.zeros(NOTE // 2 * (int(i or 0) % 7))
                    out.append(encode_wav(np.concatenate([lead, wave[notes].ravel()]), RATE))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=["id", "media"])

    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).mapInArrow(run, f"id {kind}, media binary")


def audio_matches(spark, sf_dir: str) -> DataFrame:
    """Every recording held against all whose id is divisible by 100: ``vec_id, n_frames, n_matches``, the sum of the
    matching query ids, and the alignment of the least error rate (ties by query id); nulls without a match.

    One row a recording, whatever the size of a group of equal ones: matches
    are found and combined by class of equal fingerprints, and a recording's
    own class counts without itself.
    """
    prints = cut(fingerprints(render(table(spark, sf_dir, "embeddings")), "id", "media"), "fingerprints")
    return matches_by_recording(prints, F.col("id") % 100 == 0)


def matches_by_recording(prints: DataFrame, is_query: Column) -> DataFrame:
    """:func:`audio_matches` of :func:`fingerprints`; rows with a null id, which match nothing, come back too."""
    members = _classes(prints)
    recordings = cut(_one_of_each(members), "recordings")
    asked = members.where(is_query)
    counts = cut(asked.groupBy("name").agg(F.count(F.lit(1)).alias("q_n"), F.sum("id").alias("q_sum"), F.min("id").alias("q_least")), "query-counts")
    second = asked.join(counts.select("name", "q_least"), "name").where(F.col("id") > F.col("q_least")).groupBy("name").agg(F.min("id").alias("q_second"))
    wanted = cut(recordings.join(counts, "name").join(second, "name", "left"), "queries")
    found = class_matches(wanted, recordings).join(wanted.select(F.col("name").alias("q"), "q_n", "q_sum", F.col("q_least").alias("query_id")), "q")
    fields = ("query_id", "offset", "votes", "overlap", "bit_errors", "error_rate")
    best = F.min(F.struct("error_rate", "query_id", F.struct(*fields).alias("row")))
    by_class = found.groupBy("r").agg(F.sum("q_n").alias("o_n"), F.sum("q_sum").alias("o_sum"), best.alias("o_best"))
    own = wanted.select(F.col("name").alias("w"), "q_n", "q_sum", "q_least", "q_second", *_own(F.col("fingerprint"))).where(F.col("votes") >= LEAST_VOTES)
    # one row a name on the right of every join, so adaptive execution may split a name that very many recordings bear
    named = prints.select("id", F.size("fingerprint").alias("n_frames"), F.sha2(F.concat_ws(",", F.col("fingerprint").cast("array<string>")), 256).alias("name"))
    rows = named.join(by_class, F.col("name") == F.col("r"), "left").join(own, F.col("name") == F.col("w"), "left")
    mine = F.col("w").isNotNull() & is_query
    nearest = F.when(mine & (F.col("id") == F.col("q_least")), F.col("q_second")).otherwise(F.col("q_least"))
    rows = rows.withColumn("query_id", nearest)
    own_row = F.when(F.col("query_id").isNotNull(), F.struct("error_rate", "query_id", F.struct(*fields).alias("row")))
    n = F.coalesce("o_n", F.lit(0)) + F.coalesce("q_n", F.lit(0)) - mine.cast("int")
    total = F.coalesce("o_sum", F.lit(0)) + F.coalesce("q_sum", F.lit(0)) - F.when(mine, F.col("id")).otherwise(0)
    known = F.col("id").isNotNull()
    rows = rows.select(F.col("id").alias("vec_id"), "n_frames", F.when(known, n).otherwise(F.lit(0)).alias("n_matches"), F.when(known & (n > 0), total).alias("sum_query_ids"), F.when(known, F.least(own_row, F.col("o_best"))).alias("best"))
    return rows.select("vec_id", "n_frames", "n_matches", "sum_query_ids", "best.row.*")
