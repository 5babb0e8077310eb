"""Candidate retrieval: a union of frequency-capped equi-joins (J1-J5), evidence, overlap rescoring, top-k.

A record of the query side meets the pool through its K rarest tokens, exact
keys, unordered pairs of adjacent tokens and a prefix of the space-free core
name. Keys that more than a cap of pool records bear are never used; the cap is
applied before the join, so it bounds the rows that any key can produce.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import canonical, document_frequency, postings


@dataclass(frozen=True)
class Config:
    """Caps and widths of retrieval (P15); 0 or () turns a family off."""

    df_cap: int = 300
    k_name: int = 3
    k_address: int = 4
    exact_cap: int = 300
    name_bigram_cap: int = 300
    address_bigram_cap: int = 300
    prefix_lengths: tuple[int, ...] = (8,)
    prefix_cap: int = 300
    width_name: int = 8
    width_address: int = 16
    max_candidates: int = 30


EVIDENCE = ("n_name_shared", "n_addr_shared", "idf_name", "idf_addr", "exact_name", "exact_compact", "postal_eq", "n_addr_bigram", "n_name_bigram", "n_prefix")
PAIR = ("country", "s1_id", "pool_id")


def records(df: DataFrame) -> DataFrame:
    """The columns that retrieval needs of normalised records."""
    return df.select("country", F.col("entity_id").alias("id"), "name_tokens", "address_tokens", "name_normalized", "name_compact", "name_core", "postal_code")


def rarest_tokens(query: DataFrame, stats: DataFrame, words: str, k: int, cap: int) -> DataFrame:
    """Of each query record the ``k`` rarest tokens that the pool bears at most ``cap`` times, ties by token."""
    order = Window.partitionBy("country", "id").orderBy("df", "token")
    known = postings(query, words, "country", "id").join(stats.where(F.col("df") <= cap), ["country", "token"])
    return known.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def rare_token_join(query: DataFrame, pool: DataFrame, words: str, k: int, cap: int) -> DataFrame:
    """``country, s1_id, pool_id, n, w``: shared rare tokens and their IDF sum."""
    stats = document_frequency(pool, words)
    lookups = rarest_tokens(query, stats, words, k, cap).select("country", "token", F.col("id").alias("s1_id"), "idf")
    held = postings(pool, words, "country", F.col("id").alias("pool_id"))
    return lookups.join(held, ["country", "token"]).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), F.sum("idf").alias("w"))


def key_join(query: DataFrame, pool: DataFrame, cap: int) -> DataFrame:
    """Pairs with equal ``key`` (``country, id, key`` on both sides); keys on more than ``cap`` pool rows don't count. ``n`` counts matches."""
    sizes = pool.groupBy("country", "key").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= cap)
    lookups = query.withColumnRenamed("id", "s1_id").join(sizes.select("country", "key"), ["country", "key"])
    return lookups.join(pool.withColumnRenamed("id", "pool_id"), ["country", "key"]).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))


def exact_keys(df: DataFrame, column: str) -> DataFrame:
    return df.select("country", "id", F.col(column).alias("key")).where(F.coalesce("key", F.lit("")) != "")


def bigram_keys(df: DataFrame, words: str) -> DataFrame:
    """Unordered pairs of adjacent tokens, repeats kept."""
    w = canonical(F.col(words))
    pairs = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.least(F.element_at(w, i), F.element_at(w, i + 1)), F.greatest(F.element_at(w, i), F.element_at(w, i + 1))))).otherwise(F.array().cast("array<string>"))
    return df.select("country", "id", F.explode(pairs).alias("key"))


def prefix_keys(df: DataFrame, length: int) -> DataFrame:
    core = F.replace(F.col("name_core"), F.lit(" "), F.lit(""))
    return df.where(F.length(core) >= length).select("country", "id", F.substring(core, 1, length).alias("key"))


def evidence(query: DataFrame, pool: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Every pair that a rule retrieves with the evidence of all rules, missing evidence 0.

    One union of typed rows and one aggregation stand for the chain of outer
    joins, so pairs are shuffled once.
    """
    rules: list[tuple[DataFrame, str, str | None]] = [
        (rare_token_join(query, pool, "name_tokens", cfg.k_name, cfg.df_cap), "n_name_shared", "idf_name"),
        (rare_token_join(query, pool, "address_tokens", cfg.k_address, cfg.df_cap), "n_addr_shared", "idf_addr"),
        *[(key_join(exact_keys(query, c), exact_keys(pool, c), cfg.exact_cap), n, None) for c, n in (("name_normalized", "exact_name"), ("name_compact", "exact_compact"), ("postal_code", "postal_eq"))],
    ]
    if cfg.name_bigram_cap:
        rules.append((key_join(bigram_keys(query, "name_tokens"), bigram_keys(pool, "name_tokens"), cfg.name_bigram_cap), "n_name_bigram", None))
    if cfg.address_bigram_cap:
        rules.append((key_join(bigram_keys(query, "address_tokens"), bigram_keys(pool, "address_tokens"), cfg.address_bigram_cap), "n_addr_bigram", None))
    # a prefix family counts lengths that hit, not postings
    rules += [(key_join(prefix_keys(query, n), prefix_keys(pool, n), cfg.prefix_cap).withColumn("n", F.lit(1)), "n_prefix", None) for n in cfg.prefix_lengths]
    typed = [df.select(*PAIR, F.lit(name).alias("rule"), F.col("n").cast("long").alias("n"), (F.col("w") if weight else F.lit(0.0)).cast("double").alias("w")) for df, name, weight in rules]
    long = reduce(DataFrame.unionByName, typed)

    def total(rule: str, column: str = "n") -> Column:
        zero = F.lit(0.0) if column == "w" else F.lit(0).cast("long")
        return F.sum(F.when(F.col("rule") == rule, F.col(column)).otherwise(zero))

    found = long.groupBy(*PAIR).agg(
        total("n_name_shared").alias("n_name_shared"), total("n_addr_shared").alias("n_addr_shared"), total("n_name_shared", "w").alias("idf_name"), total("n_addr_shared", "w").alias("idf_addr"),
        *[F.least(total(n), F.lit(1)).alias(n) for n in ("exact_name", "exact_compact", "postal_eq")], *[total(n).alias(n) for n in ("n_addr_bigram", "n_name_bigram", "n_prefix")],
    )
    counted = [c for c in EVIDENCE if not c.startswith("idf")]
    return found.withColumns({
        "n_strategies": reduce(Column.__add__, [(F.col(c) > 0).cast("long") for c in counted]),
        "block_score": F.col("idf_name") + F.col("idf_addr") + 6.0 * F.col("exact_name") + 4.0 * F.col("exact_compact") + 3.0 * F.col("postal_eq"),
    })


def overlap(pairs: DataFrame, query: DataFrame, pool: DataFrame, words: str, width: int, name: str) -> DataFrame:
    """``2 * shared / (mass1 + mass2)``; shared counts query slots among the first ``width`` known tokens,
    masses every slot, unknown tokens at ``ln(N + 1)``."""
    stats = document_frequency(pool, words).select("country", "token", "idf", "pool_size")
    sizes = stats.groupBy("country").agg(F.max("pool_size").alias("pool_size"))

    def slots(df: DataFrame, key: str) -> DataFrame:
        cells = df.select("country", F.col("id").alias(key), F.posexplode(canonical(F.col(words))).alias("at", "token"))
        cells = cells.join(stats.select("country", "token", "idf"), ["country", "token"], "left").join(sizes, "country")
        known = F.array_sort(F.filter(F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("at", "token", "idf"))), lambda s: s.isNotNull()))
        return cells.groupBy("country", key).agg(F.sum(F.coalesce("idf", F.log(F.col("pool_size") + 1.0))).alias("mass"), F.slice(known, 1, width).alias("known"))

    left, right = slots(query, "s1_id"), slots(pool, "pool_id")
    right = right.select("country", "pool_id", F.col("mass").alias("mass2"), F.transform("known", lambda s: s["token"]).alias("held"))
    joined = pairs.join(left, ["country", "s1_id"], "left").join(right, ["country", "pool_id"], "left")
    shared = F.aggregate(F.filter("known", lambda s: F.array_contains("held", s["token"])), F.lit(0.0), lambda total, s: total + s["idf"])
    mass = F.coalesce("mass", F.lit(0.0)) + F.coalesce("mass2", F.lit(0.0))
    return joined.withColumn(name, F.coalesce(F.when(mass > 0, 2.0 * shared / mass), F.lit(0.0))).drop("mass", "mass2", "known", "held")


def heuristic_rank() -> Column:
    """L2: address overlap outweighs name overlap."""
    return F.col("ov_name") + 1.5 * F.col("ov_addr")


def select_top(pairs: DataFrame, score: Column | str, k: int, floor: float | None = None, keep: int = 0, entity: tuple[str, ...] = ("country", "s1_id"), tie: str = "pool_id") -> DataFrame:
    """The best ``k`` of each entity, those below ``floor`` only among its first ``keep``."""
    value = F.col(score) if isinstance(score, str) else score
    rows = pairs.withColumn("place", F.row_number().over(Window.partitionBy(*entity).orderBy(value.desc(), tie))).where(F.col("place") <= k)
    if floor is not None:
        rows = rows.where((value >= floor) | (F.col("place") <= keep))
    return rows


def block(query: DataFrame, pool: DataFrame, cfg: Config = Config(), rank: Column | None = None) -> DataFrame:
    """Candidates of each query record with evidence, overlaps, ``rank_score`` and ``place``, best first."""
    pairs = evidence(query, pool, cfg)
    pairs = overlap(pairs, query, pool, "name_tokens", cfg.width_name, "ov_name")
    pairs = overlap(pairs, query, pool, "address_tokens", cfg.width_address, "ov_addr")
    pairs = pairs.withColumn("rank_score", heuristic_rank() if rank is None else rank)
    # equal sums in another order differ in the last digits; ties are judged at nine
    return select_top(pairs, F.round("rank_score", 9), cfg.max_candidates)
