"""Mixing sources to target weights over a time-varying curriculum (operator 3).

DataFrame functions only. Each source has a weight schedule over training time
0..1, piecewise linear. Its integral up to ``t`` is the share of the source's
target that is due by ``t``; inverting it turns the cumulative token count of
a document within its source into the document's training position. Documents
are then range-sorted by position.

The cumulative counts use two levels, so a source with a third of all rows is
not one task: rows fall into 4,096 ranges of a hash of id and text, sums of
the ranges are accumulated for each source, and rows only within their range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_with, cut, partitions, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by the sources' order, repeating.
WEIGHTS = (1, 2, 3)
#: Relative weight at knots of training time, by the sources' order: early, even, late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))
#: No document is taken more often.
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def row_hash(row_id: Column, text: Column) -> Column:
    """What orders a source's rows: a digest of id and text, so null and repeated ids with different texts are spread too."""
    return F.md5(F.concat(F.coalesce(row_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text.cast("string"), F.lit("")))))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of ``(source, source_size)``: shares of the total by weight, none above ``max_epochs`` sizes.

    Sources in code-point order, null last, weigh ``weights``, repeating. The
    excess over a limit is shared out again by weight until none is above: the
    sources are filled in the order of limit over weight, and those before the
    first that stays below its limit are full. One row a source, so the single
    task of the running sums holds source names, not documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    ranked = sizes.withColumn("place", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % n + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_epochs)
    by_ratio = Window.orderBy((F.col("cap").cast("double") / F.col("weight")).asc(), "place")
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.col("left") - F.col("caps_before")).cast("double") / F.col("weight_left").cast("double")
    ranked = ranked.withColumns({
        "left": F.sum("source_size").over(everything),
        "caps_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    ranked = ranked.withColumn("open", F.col("cap").cast("double") >= level * F.col("weight"))
    first_open = F.min(F.when(F.col("open"), F.struct((F.col("cap").cast("double") / F.col("weight")).alias("r"), F.col("place").alias("p"), level.alias("level")))).over(everything)
    ranked = ranked.withColumn("first", first_open)
    is_full = (F.col("cap").cast("double") / F.col("weight") < F.col("first.r")) | ((F.col("cap").cast("double") / F.col("weight") == F.col("first.r")) & (F.col("place") < F.col("first.p")))
    target = F.when(F.col("first").isNull() | is_full, F.col("cap").cast("double")).otherwise(F.least(F.col("first.level") * F.col("weight"), F.col("cap").cast("double")))
    return ranked.select("source", "source_size", "place", target.alias("target"))


def invert_schedule(share: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The time by which ``share`` of the integral of a piecewise linear schedule has passed."""
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        if min(w0, w1) < 0 or t1 <= t0:
            raise ValueError("weights must be at least 0 and knots must ascend")
        area = (w0 + w1) / 2 * (t1 - t0)
        pieces.append((t0, t1, w0, (w1 - w0) / (t1 - t0), total))
        total += area
    if total <= 0:
        raise ValueError("a schedule needs a positive integral")
    due = share * F.lit(total)
    out = None
    for t0, t1, w0, slope, at in reversed(pieces):
        x = F.greatest(due - F.lit(at), F.lit(0.0))
        # the stable root of slope/2 u^2 + w0 u = x
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + x * F.lit(2.0 * slope), F.lit(0.0))) + F.lit(w0)
        when = F.least(F.lit(t0) + F.when(root > 0, x * 2.0 / root).otherwise(F.lit(0.0)), F.lit(t1))
        out = when if out is None else F.when(due < F.lit(nxt), when).otherwise(out)
        nxt = at
    return out


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int], schedules: Sequence[Sequence[tuple[float, float]]], max_epochs: int) -> DataFrame:
    """``doc_id, x_hash, source, size, source_size, target`` and ``copies``: epoch, taken and position of each copy that the mix takes."""
    one = docs.select(F.col(id_col).alias("doc_id"), row_hash(F.col(id_col), F.col(text_col)).alias("x_hash"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    one = cut(one, "mix-sizes")  # the texts are read once
    one = one.withColumn("x_bucket", F.substring("x_hash", 1, 3))
    ranges = one.groupBy("source", "x_bucket").agg(F.sum("size").alias("x_sum"))
    so_far = Window.partitionBy("source").orderBy("x_bucket")
    ranges = ranges.withColumn("x_before", F.sum("x_sum").over(so_far) - F.col("x_sum"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("x_sum").alias("source_size")), weights, max_epochs)
    ranges = ranges.select(F.col("source").alias("r_source"), F.col("x_bucket").alias("r_bucket"), "x_before")
    targets = targets.select(F.col("source").alias("t_source"), "source_size", "place", "target")
    within = Window.partitionBy("source", "x_bucket").orderBy("x_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = one.withColumn("x_within", F.sum("size").over(within) - F.col("size"))
    # (source, bucket) is unique among the ranges and a bucket holds a small part of any source
    one = one.join(ranges, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("x_bucket") == F.col("r_bucket")))
    one = one.join(targets, F.col("source").eqNullSafe(F.col("t_source")))
    copies = []
    for epoch in range(max_epochs):
        start = F.col("x_before") + F.col("x_within") + F.col("source_size") * epoch
        taken = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - start)).cast("long")
        share = F.when(F.col("target") > 0, start / F.col("target"))
        position = None
        for j in reversed(range(len(schedules))):
            p = invert_schedule(share, schedules[j])
            position = p if position is None else F.when(F.col("place") % len(schedules) == j, p).otherwise(position)
        copies.append(F.struct(F.lit(epoch).alias("epoch"), taken.alias("taken"), position.alias("position")))
    taken_ones = F.filter(F.array(*copies), lambda c: c["taken"] > 0)
    return one.select("doc_id", "x_hash", "source", "size", "source_size", "target", taken_ones.alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row a document: ``doc_id, source, size, source_size, target, taken, position``.

    ``size`` counts words, null text 0. A source is read in the order of a hash
    of id and text, over and over, until its target is met; ``taken`` is the words
    the mix takes from the document, repeats counted, and the document at the
    target's edge gives its first words only. So the taken words of a source
    are its target rounded down, and none exceeds ``max_epochs`` sizes.
    ``position`` is the training time of the first taken word; null if nothing
    is taken. A source of size 0 has target 0. Ties of the hash go by id, then
    size; rows that repeat an id each count. Null is a source of its own.
    Reruns agree. Other columns are left out.
    """
    rows = _plan(docs, id_col, text_col, source_col, weights, schedules, max_epochs)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda total, c: total + c["taken"])
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), F.get("copies", F.lit(0))["position"].alias("position"))


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """:func:`mix`, range-sorted by training position; documents that are not taken come last."""
    rows = mix(docs, **options)
    return rows.repartitionByRange(partitions(docs.sparkSession), F.col("position").asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The training sequence: a row of ``docs`` for each copy that the mix takes, range-sorted by position; same columns.

    Copies are whole documents, so a source exceeds its target by less than one
    document. Each row has its own copies, whatever its id; rows that are equal
    in id and text share out theirs among themselves.
    """
    key, copies, position, at, source = unused(docs, "x_key", "x_copies", "x_position", "x_at", "x_from")
    plan = _plan(docs, id_col, text_col, source_col, weights, schedules, max_epochs)
    # one list a hash: longer than one entry only where rows are equal
    plan = plan.groupBy("x_hash", F.col("source").alias(source)).agg(F.collect_list("copies").alias(copies)).where(F.exists(copies, lambda c: F.size(c) > 0)).withColumnRenamed("x_hash", key)
    (mine,) = unused(docs, "x_mine")
    rows = docs.withColumn(mine, row_hash(F.col(id_col), F.col(text_col)))
    rows = rows.join(plan, (F.col(mine) == F.col(key)) & F.col(source_col).eqNullSafe(F.col(source)))
    single = rows.where(F.size(copies) == 1).withColumn(at, F.lit(1))
    several = rows.where(F.size(copies) > 1).withColumn(at, F.row_number().over(Window.partitionBy(key, source).orderBy(id_col)))
    rows = single.unionByName(several).withColumn(position, F.explode(F.get(F.col(copies), F.col(at) - 1)["position"]))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), F.col(position), F.col(id_col)).sortWithinPartitions(position, id_col)
    return columns_with(rows, {}, docs.columns)
