"""Pair features (C4), the candidate filter's features (C5) and relative ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity, tokens
from ..functions.text import strip_leading_zeros

ENTITY = ("country", "s1_id")
#: Codes of name scripts; others count as ``other``.
SCRIPT_CODES = {"latin": 0, "latin_accent": 1, "devanagari": 2, "bengali": 3, "gurmukhi": 4, "gujarati": 5, "oriya": 6, "tamil": 7, "telugu": 8, "kannada": 9, "malayalam": 10}
SIDE = ("name_tokens", "address_tokens", "name_normalized", "name_core", "address_normalized", "postal_code", "house_number", "name_script")


def script_code(x: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in SCRIPT_CODES.items() for v in pair])
    return F.coalesce(F.try_element_at(table, x), F.lit(len(SCRIPT_CODES)))


def rank_desc(value: Column | str, entity: tuple[str, ...] = ENTITY, tie: str = "pool_id") -> Column:
    """1-based, nulls last, ties by ``tie``."""
    value = F.col(value) if isinstance(value, str) else value
    return F.row_number().over(Window.partitionBy(*entity).orderBy(value.desc_nulls_last(), tie))


def gap_to_best(value: str, entity: tuple[str, ...] = ENTITY) -> Column:
    """Null values stay null."""
    return F.max(value).over(Window.partitionBy(*entity)) - F.col(value)


def flags() -> dict[str, Column]:
    """P10: missing fields, equal fields, postal and house numbers, of columns ``x_1`` and ``x_2``."""
    def both(c: str) -> Column:
        return (F.length(f"{c}_1") > 0) & (F.length(f"{c}_2") > 0)

    def equal(c: str) -> Column:
        return (both(c) & (F.col(f"{c}_1") == F.col(f"{c}_2"))).cast("int")

    out = {f"{n}_missing_{s}": (F.length(f"{c}_{s}") == 0).cast("int") for n, c in (("name", "name_normalized"), ("addr", "address_normalized")) for s in (1, 2)}
    out |= {"name_exact_normalized": equal("name_normalized"), "name_exact_core": equal("name_core"), "addr_exact_normalized": equal("address_normalized")}
    for name, c, f in (("postal", "postal_code", lambda x: x), ("housenum", "house_number", strip_leading_zeros)):
        a, b = f(F.col(f"{c}_1")), f(F.col(f"{c}_2"))
        present = a.isNotNull() & b.isNotNull()
        out |= {f"{name}_both_present": present.cast("int"), f"{name}_match": F.coalesce(present & (a == b), F.lit(False)).cast("int")}
    return out


def with_sides(pairs: DataFrame, query: DataFrame, pool: DataFrame, columns: tuple[str, ...] = SIDE) -> DataFrame:
    left = query.select("country", F.col("entity_id").alias("s1_id"), *[F.col(c).alias(f"{c}_1") for c in columns])
    right = pool.select("country", F.col("entity_id").alias("pool_id"), "source", *[F.col(c).alias(f"{c}_2") for c in columns])
    return pairs.join(left, ["country", "s1_id"]).join(right, ["country", "pool_id"])


def relative(rows: DataFrame, score: str = "rank_score") -> DataFrame:
    """P11, W4-W7 of pairs with ``name_ratio`` and ``addr_ratio``."""
    name, addr = F.coalesce("name_ratio", F.lit(0.0)), F.coalesce("addr_ratio", F.lit(0.0))
    entity = Window.partitionBy(*ENTITY)
    rows = rows.withColumns({"sim_min": F.least(name, addr), "sim_max": F.greatest(name, addr), "sim_prod": name * addr, "prelim_score": 0.5 * name + 0.5 * addr})
    return rows.withColumns({
        "prelim_rank": rank_desc("prelim_score"), "prelim_gap_to_best": gap_to_best("prelim_score"), "name_ratio_gap": gap_to_best("name_ratio"), "addr_ratio_gap": gap_to_best("addr_ratio"),
        "block_rank": rank_desc(F.round(score, 9)), "block_gap_to_best": gap_to_best(score), "n_candidates_for_entity": F.count(F.lit(1)).over(entity),
        "n_name_ge90": F.sum((name >= 0.9).cast("int")).over(entity), "n_addr_ge80": F.sum((addr >= 0.8).cast("int")).over(entity),
        "n_both_strong": F.sum(((name >= 0.85) & (addr >= 0.7)).cast("int")).over(entity), "is_name_top1": (name >= F.max(name).over(entity)).cast("int"),
    })


def _similar(rows: DataFrame, names: dict[str, tuple[str, tuple[str, ...]]]) -> DataFrame:
    for prefix, (column, scorers) in names.items():
        rows = rows.withColumn("x_sim", similarity.scores(F.col(f"{column}_1"), F.col(f"{column}_2"), scorers))
        rows = rows.withColumns({f"{prefix}_{s}": F.col("x_sim")[s] for s in scorers}).drop("x_sim")
    return rows


def pair_features(pairs: DataFrame, query: DataFrame, pool: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """C4: the matcher's features for the blocker's pairs; similarities are null where a side is empty.

    ``universe`` is the full query split where ``query`` is a sample of it.
    Frequencies count on each record once, before the join to pairs. ``pairs``
    is read more than once; materialise it if it is costly.
    """
    freq = {"pool_name_freq": "name_normalized", "pool_core_freq": "name_core", "pool_addr_freq": "address_normalized"}
    pool_counts = pool.select("country", F.col("entity_id").alias("pool_id"), *[F.log1p(tokens.value_frequency(pool, c)).alias(n) for n, c in freq.items()])
    # these joins read their pairs several times: before the similarities, not after
    for prefix, words in (("nt", "name_tokens"), ("at", "address_tokens")):
        left, right = (df.withColumnRenamed("entity_id", k) for df, k in ((query, "s1_id"), (pool, "pool_id")))
        pairs = tokens.weighted_overlap(pairs, left, right, tokens.document_frequency(pool, words), words, ("s1_id", "pool_id"), prefix)
    whole = query if universe is None else universe
    s1_counts = whole.select("country", F.col("entity_id").alias("s1_id"), F.log1p(tokens.value_frequency(whole, "name_core")).alias("s1_core_freq"), F.log1p(tokens.value_frequency(whole, "address_normalized")).alias("s1_addr_freq"))
    rows = with_sides(pairs, query, pool).join(pool_counts, ["country", "pool_id"]).join(s1_counts, ["country", "s1_id"])
    rows = rows.withColumns(flags())
    rows = _similar(rows, {"name": ("name_normalized", tuple(similarity.SCORERS)), "core": ("name_core", tuple(s for s in similarity.SCORERS if s != "partial")), "addr": ("address_normalized", tuple(similarity.SCORERS))})
    rows = rows.withColumns({f"{n}_len_{s}": F.length(f"{c}_{s}") for n, c in (("name", "name_normalized"), ("addr", "address_normalized")) for s in (1, 2)})
    rows = rows.withColumns({f"{n}_len_diff": F.abs(F.col(f"{n}_len_1") - F.col(f"{n}_len_2")) for n in ("name", "addr")})
    for prefix, words in (("nt", "name_tokens"), ("at", "address_tokens")):
        rows = rows.withColumns({f"{prefix}_{k}": v for k, v in tokens.shares(F.col(f"{words}_1"), F.col(f"{words}_2")).items()})
    rows = rows.withColumns({"name_script_1": script_code(F.col("name_script_1")), "name_script_2": script_code(F.col("name_script_2")), "is_s2": (F.col("source") == "S2").cast("int")})
    rows = rows.withColumn("name_script_match", (F.col("name_script_1") == F.col("name_script_2")).cast("int"))
    rows = rows.withColumns({"pool_addr_freq": F.when(F.col("addr_missing_2") == 0, F.col("pool_addr_freq")), "s1_addr_freq": F.when(F.col("addr_missing_1") == 0, F.col("s1_addr_freq"))})
    rows = relative(rows)
    return rows.drop("source", *[f"{c}_{s}" for c in SIDE if c != "name_script" for s in (1, 2)])


FILTER_FEATURES = (
    "ov_name", "ov_addr", "n_addr_bigram", "n_name_bigram", "n_prefix", "exact_name", "exact_compact", "postal_eq", "n_strategies",
    "s1_ntok_name", "s1_ntok_addr", "c_ntok_name", "c_ntok_addr", "block_rank", "is_s2",
    "name_token_set", "name_partial", "core_ratio", "core_jw", "addr_token_set", "addr_partial", "addr_ratio",
    "name_missing_2", "addr_missing_2", "housenum_both_present", "housenum_match",
)


def filter_features(pairs: DataFrame, query: DataFrame, pool: DataFrame) -> DataFrame:
    """The candidate filter's 26 features of shortlisted pairs."""
    rows = with_sides(pairs, query, pool).withColumns(flags())
    rows = _similar(rows, {"name": ("name_normalized", ("token_set", "partial")), "core": ("name_core", ("ratio", "jw")), "addr": ("address_normalized", ("token_set", "partial", "ratio"))})
    rows = rows.withColumns({f"{s}_ntok_{n}": F.size(f"{c}_{i}") for n, c in (("name", "name_tokens"), ("addr", "address_tokens")) for s, i in (("s1", 1), ("c", 2))})
    rows = rows.withColumns({"block_rank": rank_desc(F.round("rank_score", 9)), "is_s2": (F.col("source") == "S2").cast("int")})
    return rows.select("country", "s1_id", "pool_id", *FILTER_FEATURES)
