"""Exact duplicates by content sort (operator 10), DataFrame functions only.

Sampled splitters range-partition the texts' bytes (their heads, then a hash), the external sort of each
partition places equal texts side by side, and one pass over neighbours, which
compares them in full, finds each group's size and the row that stays. Sorting
alone would put a text that makes up a third of the corpus into one task, so a
bounded sample first tells which texts are that frequent. Those skip the sort:
they are counted by a map-side combine on the full text, and their totals, a
bounded number of short rows, are broadcast back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_with, partitions, unused

#: Rows sampled for each partition, and the sampled copies from which a text is frequent.
SAMPLE_PER_PARTITION = 200
FREQUENT_COPIES = 25
#: Characters of a text that range-partition it, before a hash of all of it.
HEAD = 24


def _frequent_keys(docs: DataFrame, text: Column) -> list[int]:
    """Hashes of frequent texts: at most ``SAMPLE_PER_PARTITION / FREQUENT_COPIES`` times the partitions.

    Only routing depends on the sample; any routing gives the same result.
    """
    wanted = SAMPLE_PER_PARTITION * partitions(docs.sparkSession)
    rows = docs.count()
    drawn = docs.select(F.xxhash64(text).alias("h"))
    if rows > wanted:
        drawn = docs.sample(wanted / rows, seed=17).select(F.xxhash64(text).alias("h"))
    found = drawn.groupBy("h").count().where(F.col("count") >= FREQUENT_COPIES).orderBy("h")
    return [r["h"] for r in found.limit(2 * wanted // FREQUENT_COPIES).collect()]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """All rows and columns of ``docs`` with ``keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after no change; null counts as the empty
    text. Of equal texts the row with the largest id stays (``keep="min"``:
    the smallest). A null id stays only where all ids of the group are null.
    Rows that repeat an id and a text are one document and share the verdict.
    An empty table gives an empty result. Input columns that bear a result
    column's name are replaced by it.
    """
    best = {"max": F.max, "min": F.min}[keep]
    t, k, g, head, mark = unused(docs, "x_text", "x_keep", "x_size", "x_head", "x_mark")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    frequent = _frequent_keys(docs, text)
    rows = docs.withColumn(t, text)
    is_frequent = F.xxhash64(t).isin(frequent) if frequent else F.lit(False)

    # The splitters' sample goes to the driver, so it holds each text's head and a hash, not the text;
    # texts that share a head are spread by the hash. Equality is judged on the whole text.
    equal = Window.partitionBy(head, mark, t)
    found = (
        rows.where(~is_frequent)
        .withColumns({head: F.substring(t, 1, HEAD), mark: F.xxhash64(t)})
        .repartitionByRange(partitions(docs.sparkSession), F.col(head), F.col(mark))
        .withColumns({k: best(id_col).over(equal), g: F.count(F.lit(1)).over(equal)})
        .drop(head, mark)
    )
    if frequent:
        (s,) = unused(docs, "x_sha")
        hot = rows.where(is_frequent)
        totals = hot.groupBy(t).agg(best(id_col).alias(k), F.count(F.lit(1)).alias(g)).select(F.sha2(t, 256).alias(s), k, g)
        hot = hot.withColumn(s, F.sha2(t, 256)).join(F.broadcast(totals), s).drop(s)
        found = found.unionByName(hot)
    added = {"keep_id": F.col(k), "group_size": F.col(g), "kept": F.col(id_col).eqNullSafe(F.col(k)), "text_sha256": F.sha2(t, 256)}
    return columns_with(found, added, docs.columns)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """``docs`` with one document of each group of equal texts; same columns."""
    (flag,) = unused(docs, "x_kept")
    if {c.lower() for c in docs.columns} & {"keep_id", "group_size", "kept", "text_sha256"}:
        # carry clashing columns in a struct while the verdicts bear their names
        (held,) = unused(docs, "x_row")
        packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(held), F.col(id_col).alias("x_id"), F.col(text_col).alias("x_text"))
        return exact_dedup(packed, "x_id", "x_text", keep).where("kept").select(f"{held}.*")
    return exact_dedup(docs, id_col, text_col, keep).withColumnRenamed("kept", flag).where(F.col(flag)).select(*[F.col(f"`{c}`") for c in docs.columns])
