"""URL filters by a sort-merge range join (operator 9).

A host's labels are reversed and each ends with a dot, so a rule for a host and
all its subdomains is one interval of keys: those that begin with the rule's
key. Splitters sampled from the URLs cut the keys, ties broken by a hash of the
row, into ranges; a rule goes to every range that its interval meets. Each range
is sorted, rules before URLs, and swept once with a stack of the nested rules
that are active; no URL is compared with a rule that doesn't enclose its host.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: URLs sampled for each range's splitter.
SAMPLE_PER_RANGE = 60
_LAST = "\U0010ffff"


def host_of(url: Column) -> Column:
    rest = _after_scheme(url)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def reversed_key(host: Column) -> Column:
    """``www.example.com`` to ``com.example.www.``; the empty host to the empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


class Sweep:
    """The stack of active hosts, each with its paths, over keys in ascending order."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, dict[str, tuple[str, str]]]] = []

    def _leave(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def enter(self, key: str, path: str, rule: str, verdict: str) -> None:
        self._leave(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}))
        paths = self.stack[-1][1]
        # the same rule twice: a block outweighs an allow
        if path not in paths or verdict == "block":
            paths[path] = (rule, verdict)

    def judge(self, key: str, path: str) -> tuple[str, str] | None:
        """The longest active rule whose path begins ``path``; of equal length, that of the longer host."""
        self._leave(key)
        best = None
        for _, paths in reversed(self.stack):
            if len(paths) <= len(path):
                fits = [x for p, x in paths.items() if path.startswith(p)]
            else:
                fits = [paths[path[:n]] for n in range(len(path) + 1) if path[:n] in paths]
            for rule in fits:
                if best is None or len(rule[0]) > len(best[0]):
                    best = rule
        return best


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row a page: ``page_id, host, path, rule, verdict``.

    ``rules`` has ``host, path, verdict``. A rule fits its host and all
    subdomains if the URL's path starts with the rule's; the longest wins, at
    equal length that of the longer host, and of the same rule given twice
    ``block``. Pages without a fitting rule get ``default`` and a null rule. A
    null URL or one without ``://`` has empty host and path, which no rule
    fits. Rules with a null or empty host are left out; a null path is empty.
    Repeated rows each give a row; empty tables are fine.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.xxhash64(F.col(id_col), url).alias("tie"))
    rows = rows.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))}).withColumn("key", reversed_key(F.col("host")))
    rules = rules.select(F.col("host").cast("string"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("verdict").cast("string")).where(F.coalesce(F.col("host"), F.lit("")) != "")
    rules = rules.withColumn("key", reversed_key(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))

    ranges = partitions(spark)
    total, wanted = rows.count(), SAMPLE_PER_RANGE * ranges
    drawn = rows.select("key", "tie")
    drawn = drawn.sample(wanted / total, seed=9) if total > wanted else drawn
    sample = sorted((r["key"], r["tie"]) for r in drawn.collect())  # SAMPLE_PER_RANGE rows for each range
    splitters = sorted({sample[len(sample) * j // ranges] for j in range(1, ranges)}) if sample else []
    shared = spark.sparkContext.broadcast(splitters)

    def place_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value
        for batch in batches:
            at = [bisect_right(cuts, x) for x in zip(batch["key"].to_pylist(), batch["tie"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch["key"], pa.array([1] * len(at), pa.int32()), batch["page_id"], batch["host"], batch["path"], pa.nulls(len(at), pa.string())], names=["at", "key", "is_url", "page_id", "host", "path", "verdict"])

    def place_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                # the interval of keys that begin with the rule's
                lo, hi = bisect_left(cuts, (r["key"],)), bisect_right(cuts, (r["key"] + _LAST,))
                out += [{"at": a, "key": r["key"], "is_url": 0, "host": r["host"], "path": r["path"], "verdict": r["verdict"]} for a in range(lo, hi + 1)]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("at", pa.int32()), ("key", pa.string()), ("is_url", pa.int32()), ("host", pa.string()), ("path", pa.string()), ("verdict", pa.string())]))

    schema = f"at int, key string, is_url int, page_id {kind}, host string, path string, verdict string"

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active, here = Sweep(), None
        for batch in batches:
            keep, rule, verdict = [], [], []
            for k, (at, key, is_url, host, path, v) in enumerate(zip(*(batch[c].to_pylist() for c in ("at", "key", "is_url", "host", "path", "verdict")), strict=True)):
                if at != here:
                    active, here = Sweep(), at
                if is_url:
                    found = active.judge(key, path) or (None, default)
                    keep.append(k)
                    rule.append(found[0])
                    verdict.append(found[1])
                else:
                    active.enter(key, path, host + path, v)
            taken = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken["page_id"], taken["host"], taken["path"], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    both = rows.mapInArrow(place_urls, schema).unionByName(rules.mapInArrow(place_rules, schema.replace(f"page_id {kind}, ", "")), allowMissingColumns=True)
    ordered = both.repartitionById(len(splitters) + 1, F.col("at")).sortWithinPartitions("at", "key", "is_url", "path")
    return ordered.mapInArrow(sweep, f"page_id {kind}, host string, path string, rule string, verdict string")
