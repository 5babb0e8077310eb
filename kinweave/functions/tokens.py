"""Token statistics and overlap of token lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import strip_leading_zeros


def canonical(words: Column) -> Column:
    return F.transform(words, strip_leading_zeros)


def postings(records: DataFrame, words: str, *keep: str) -> DataFrame:
    """A row for each distinct token of a record."""
    return records.select(*keep, F.explode(F.array_distinct(canonical(F.col(words)))).alias("token"))


def document_frequency(pool: DataFrame, words: str, group: str = "country") -> DataFrame:
    """T4/T5: ``group, token, df, idf`` with ``idf = ln((N + 1) / (df + 1))`` over the group's pool."""
    sizes = pool.groupBy(group).agg(F.count(F.lit(1)).alias("pool_size"))
    counts = postings(pool, words, group).groupBy(group, "token").agg(F.count(F.lit(1)).alias("df"))
    # one row a group, so the join side is as small as the number of groups
    return counts.join(sizes, group).select(group, "token", "df", F.log((F.col("pool_size") + 1.0) / (F.col("df") + 1.0)).alias("idf"), "pool_size")


def shares(a: Column, b: Column) -> dict[str, Column]:
    """Sizes and overlap of two token lists as sets; null ratios where a side is empty."""
    a, b = F.array_distinct(canonical(a)), F.array_distinct(canonical(b))
    n1, n2, both = F.size(a), F.size(b), F.size(F.array_intersect(a, b))
    full = (n1 > 0) & (n2 > 0)

    def over(x: Column, y: Column) -> Column:
        return F.when(full, x / y)

    digits = [F.filter(x, lambda t: t.rlike("[0-9]")) for x in (a, b)]
    numbers = F.size(F.array_union(*digits))
    return {
        "n1": n1, "n2": n2, "inter": F.when(full, both), "jaccard": over(both, n1 + n2 - both), "dice": over(2.0 * both, n1 + n2),
        "cont1": over(both, n1), "cont2": over(both, n2),
        "num_jaccard": F.when(full & (F.size(digits[0]) > 0) & (F.size(digits[1]) > 0), F.size(F.array_intersect(*digits)) / F.nullif(numbers, F.lit(0))),
    }


def weighted_overlap(pairs: DataFrame, left: DataFrame, right: DataFrame, idf: DataFrame, words: str, keys: Sequence[str], prefix: str, group: str = "country") -> DataFrame:
    """IDF cosine and containments of pairs ``(*keys)``; keys[-2] and keys[-1] name the two records.

    ``left`` and ``right`` hold records under those keys. Tokens unknown to the
    pool weigh ``ln(N + 1)``.
    """
    one, two = keys[-2], keys[-1]
    sizes = idf.groupBy(group).agg(F.max("pool_size").alias("pool_size"))

    def weighted(records: DataFrame, key: str, needed: DataFrame) -> DataFrame:
        w = postings(records.join(needed, [group, key], "left_semi"), words, group, key)
        w = w.join(idf.select(group, "token", "idf"), [group, "token"], "left").join(sizes, group)
        return w.select(group, key, "token", F.coalesce("idf", F.log(F.col("pool_size") + 1.0)).alias("w"))

    a, b = weighted(left, one, pairs.select(group, one).distinct()), weighted(right, two, pairs.select(group, two).distinct())
    t1 = a.groupBy(group, one).agg(F.sum("w").alias("s1"), F.sum(F.col("w") * F.col("w")).alias("q1"))
    t2 = b.groupBy(group, two).agg(F.sum("w").alias("s2"), F.sum(F.col("w") * F.col("w")).alias("q2"))
    shared = pairs.select(group, one, two).join(a, [group, one]).join(b.select(group, two, "token"), [group, two, "token"]).groupBy(group, one, two).agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"))
    out = pairs.join(shared, [group, one, two], "left").join(t1, [group, one], "left").join(t2, [group, two], "left")
    full = F.col("s1").isNotNull() & F.col("s2").isNotNull()
    s, q = F.coalesce("s", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    return out.withColumns({
        f"{prefix}_idf_cos": F.when(full, F.coalesce(q / F.nullif(F.sqrt(F.col("q1") * F.col("q2")), F.lit(0.0)), F.lit(0.0))),
        f"{prefix}_idf_ov1": F.when(full, F.coalesce(s / F.nullif(F.col("s1"), F.lit(0.0)), F.lit(0.0))),
        f"{prefix}_idf_ov2": F.when(full, F.coalesce(s / F.nullif(F.col("s2"), F.lit(0.0)), F.lit(0.0))),
    }).drop("s", "q", "s1", "q1", "s2", "q2")


def jaccard(a: Column, b: Column) -> Column:
    """Of two normalised texts; 1 if both are empty, 0 if one is."""
    x, y = (F.array_distinct(F.filter(F.split(t, " "), lambda w: w != "")) for t in (a, b))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def value_frequency(records: DataFrame, column: str, group: str = "country") -> Column:
    """How many of the group's records bear the same value."""
    return F.count(F.lit(1)).over(Window.partitionBy(group, column))
