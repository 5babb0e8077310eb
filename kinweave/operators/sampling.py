"""Seeded samples, splits and folds (U7-U14, W14). Hashes of ids stand for a shuffled order, so a split is the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(ids: Column, seed: int) -> Column:
    """A hexadecimal rank of each id that another engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), ids.cast("string")))


def fold(ids: Column, k: int, seed: int = 0) -> Column:
    """0 .. k - 1."""
    return (F.conv(F.substring(draw(ids, seed), 1, 8), 16, 10).cast("long") % k).cast("int")


def sample(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """The ``n`` rows of least rank; a top-n, so only n rows of each task meet."""
    return df.orderBy(draw(F.col(id_col), seed), id_col).limit(n)


def split(df: DataFrame, id_col: str, val: float = 0.15, hold: float = 0.15, seed: int = 0) -> DataFrame:
    """U8: ``part`` train, val or hold by the id's rank."""
    share = F.conv(F.substring(draw(F.col(id_col), seed), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return df.withColumn("part", F.when(share < val, "val").when(share < val + hold, "hold").otherwise("train"))


def groups(df: DataFrame, id_col: str, shares: dict[str, float], seed: int = 13) -> DataFrame:
    """Disjoint named groups of about the given shares; the rest is ``pool``."""
    share = F.conv(F.substring(draw(F.col(id_col), seed), 1, 8), 16, 10).cast("long") / float(1 << 32)
    out, upto = F.lit("pool"), sum(shares.values())
    for name, part in reversed(shares.items()):
        out = F.when((share >= upto - part) & (share < upto), name).otherwise(out)
        upto -= part
    return df.withColumn("grp", out)


def bernoulli(df: DataFrame, id_col: str, rate: float, seed: int = 0) -> DataFrame:
    """Rows whose rank falls below ``rate``."""
    return df.where(F.conv(F.substring(draw(F.col(id_col), seed), 1, 8), 16, 10).cast("long") < int(rate * (1 << 32)))


def negatives(pairs: DataFrame, n_hard: int, n_random: int, score: str = "p", entity: tuple[str, ...] = ("s1_id",), tie: str = "pool_id", seed: int = 0) -> DataFrame:
    """Every positive, each entity's ``n_hard`` best negatives and ``n_random`` of the others."""
    of = Window.partitionBy(*entity, "label")
    rows = pairs.withColumn("x_hard", F.row_number().over(of.orderBy(F.col(score).desc(), tie)))
    rows = rows.withColumn("x_late", F.col("x_hard") > n_hard)
    rank = draw(F.concat_ws(":", *[F.col(c).cast("string") for c in (*entity, tie)]), seed)
    rows = rows.withColumn("x_any", F.row_number().over(Window.partitionBy(*entity, "label", "x_late").orderBy(rank, tie)))
    return rows.where((F.col("label") == 1) | ~F.col("x_late") | (F.col("x_any") <= n_random)).drop("x_hard", "x_late", "x_any")


def hard_triples(candidates: DataFrame, truth: DataFrame, seed: int = 0, entity: str = "s1_id", match: str = "pool_id") -> DataFrame:
    """Each true pair with one random candidate of the entity that isn't true, -1 if none."""
    wrong = candidates.join(truth.select(entity, match).distinct(), [entity, match], "left_anti")
    rank = draw(F.concat_ws(":", F.col(entity).cast("string"), F.col(match).cast("string")), seed)
    one = wrong.groupBy(entity).agg(F.min_by(match, F.struct(rank, F.col(match))).alias("negative_id"))
    return truth.select(entity, match).distinct().join(one, entity, "left").withColumn("negative_id", F.coalesce("negative_id", F.lit(-1).cast(candidates.schema[match].dataType)))


def orphan_world(pairs: DataFrame, share: float, entity: str = "s1_id", seed: int = 0) -> DataFrame:
    """Pairs of a world from which a random share of the entities is gone."""
    gone = bernoulli(pairs.select(entity).distinct(), entity, share, seed)
    return pairs.join(gone, entity, "left_anti")


def street_swaps(records: DataFrame, address_col: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` augmented addresses: a record's house number with another record's street, the rest kept.

    Only records whose address parses to a number and a street take part; each
    of the first ``n`` by a seeded rank takes the street of the next one.
    """
    from .graph import parsed_address

    rank = draw(F.col("entity_id"), seed)
    rows = records.select("entity_id", address_col, parsed_address(address_col).alias("a")).where(F.col("a")["number"].isNotNull() & (F.col("a")["street"] != ""))
    chosen = rows.orderBy(rank, "entity_id").limit(n + 1)  # bounded by n
    order = Window.orderBy(draw(F.col("entity_id"), seed), "entity_id")
    swapped = chosen.withColumn("other", F.lead(F.col("a")["street"]).over(order)).where(F.col("other").isNotNull())
    return swapped.select("entity_id", F.col(address_col).alias("address"), F.concat_ws(", ", F.concat_ws(" ", F.col("a")["number"], F.col("other")), F.nullif(F.col("a")["rest"], F.lit(""))).alias("swapped"))
