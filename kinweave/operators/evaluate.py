"""Scores against truth: per-entity F0.5, summaries, threshold searches and trade-off tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds tried, as multiples of 0.01.
GRID = tuple(range(5, 100))


def label_pairs(candidates: DataFrame, truth: DataFrame, entity: str = "s1_id", match: str = "pool_id") -> DataFrame:
    """``label`` 1 for true pairs; repeated truth doesn't repeat rows."""
    known = truth.select(entity, match).distinct().withColumn("label", F.lit(1))
    return candidates.join(known, [entity, match], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def f05(tp: Column, fp: Column, fn: Column) -> Column:
    """The closed form; an entity without true matches scores 1 if nothing is predicted, else 0."""
    return F.when(tp + fn == 0, F.when(tp + fp == 0, 1.0).otherwise(0.0)).otherwise(1.25 * tp / (1.25 * tp + 0.25 * fn + fp))


def score_pairs(predicted: DataFrame, truth: DataFrame, required: DataFrame, entity: str = "s1_id", match: str = "pool_id") -> DataFrame:
    """``tp, fp, fn, truth_size, pred_size, precision, recall, f05`` of every required entity."""
    sides = predicted.select(entity, match).distinct().withColumn("x_p", F.lit(1)).join(truth.select(entity, match).distinct().withColumn("x_t", F.lit(1)), [entity, match], "full")
    counts = sides.groupBy(entity).agg(F.count(F.when(F.col("x_p").isNotNull() & F.col("x_t").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("x_t").isNull(), 1)).alias("fp"), F.count(F.when(F.col("x_p").isNull(), 1)).alias("fn"))
    rows = required.select(entity).distinct().join(counts, entity, "left")
    rows = rows.select(entity, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    rows = rows.withColumns({"truth_size": F.col("tp") + F.col("fn"), "pred_size": F.col("tp") + F.col("fp")})
    singleton = F.col("truth_size") == 0
    return rows.withColumns({
        "precision": F.when(F.col("pred_size") > 0, F.col("tp") / F.col("pred_size")).when(~singleton, 0.0), "recall": F.when(~singleton, F.col("tp") / F.nullif(F.col("truth_size"), F.lit(0))),
        "f05": f05(F.col("tp"), F.col("fp"), F.col("fn")),
    })


def summarize(stats: DataFrame) -> DataFrame:
    """One row of macro figures."""
    single = F.col("truth_size") == 0

    def rate(x: Column, where: Column) -> Column:
        return F.avg(F.when(where, x.cast("double")))

    return stats.agg(
        F.count(F.lit(1)).alias("n_entities"), F.avg("f05").alias("macro_f05"), F.count(F.when(single, 1)).alias("n_singletons_true"),
        rate(F.col("pred_size") == 0, single).alias("singleton_accuracy"), rate(F.col("pred_size") > 0, single).alias("false_merge_rate_on_singletons"),
        rate(F.col("precision"), ~single).alias("mean_precision_non_singleton"), rate(F.col("recall"), ~single).alias("mean_recall_non_singleton"), rate(F.col("f05"), ~single).alias("mean_f05_non_singleton"),
        F.avg("pred_size").alias("mean_pred_size"), F.avg("truth_size").alias("mean_truth_size"), *[F.sum(c).alias(f"total_{c}") for c in ("tp", "fp", "fn")],
    )


def _cell(x: Column) -> Column:
    return F.floor(x * 100 + 1e-9).cast("int")


def sweep_levels(levels: DataFrame, required: DataFrame, entity: str = "s1_id", grid: Sequence[int] = GRID) -> DataFrame:
    """``cell, macro_f05``: the score over ``required`` (``entity, truth_size``) if the pairs of ``level`` >= cell are kept, for each cell of the grid.

    An entity's score changes only at its own levels. Pairs are counted once by
    entity and level, running sums give the entity's score there, and its
    changes are added up by level; the last running sum is over the grid.
    """
    cells = levels.where(F.col("level") >= min(grid)).groupBy(entity, F.least("level", F.lit(max(grid))).alias("level")).agg(F.sum("label").alias("tp"), F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy(entity).orderBy(F.col("level").desc())
    empty = f05(F.lit(0), F.lit(0), F.col("truth_size"))
    rows = cells.join(required, entity).withColumns({"tp": F.sum("tp").over(above), "n": F.sum("n").over(above)})
    rows = rows.withColumn("score", f05(F.col("tp"), F.col("n") - F.col("tp"), F.col("truth_size") - F.col("tp")))
    changes = rows.select("level", (F.col("score") - F.coalesce(F.lag("score").over(above), empty)).alias("change")).groupBy("level").agg(F.sum("change").alias("change"))
    base = required.agg(F.sum(empty).alias("base"), F.count(F.lit(1)).alias("entities"))
    steps = base.select("base", "entities", F.explode(F.array(*[F.lit(g) for g in grid])).alias("cell")).join(F.broadcast(changes), F.col("cell") == F.col("level"), "left")
    # one row a grid value
    total = F.col("base") + F.sum(F.coalesce("change", F.lit(0.0))).over(Window.orderBy(F.col("cell").desc()))
    return steps.select("cell", (total / F.col("entities")).alias("macro_f05"))


def threshold_sweep(labelled: DataFrame, required: DataFrame, entity: str = "s1_id", p: str = "p", grid: Sequence[int] = GRID) -> DataFrame:
    """``threshold, macro_f05`` over the grid; ``required`` has ``entity, truth_size``."""
    found = sweep_levels(labelled.select(entity, _cell(F.col(p)).alias("level"), "label"), required, entity, grid)
    return found.select((F.col("cell") / 100.0).alias("threshold"), "macro_f05")


def best_threshold(sweep: DataFrame) -> tuple[float, float]:
    """The lowest threshold of the best score; the sweep has one row a grid value."""
    row = sweep.orderBy(F.round("macro_f05", 12).desc(), "threshold").first()
    return row["threshold"], row["macro_f05"]


def macro(labelled: DataFrame, required: DataFrame, keep: Column, entity: str = "s1_id") -> float:
    """The macro score if the pairs of ``keep`` are predicted."""
    kept = labelled.where(keep).groupBy(entity).agg(F.sum("label").alias("tp"), F.count(F.lit(1)).alias("n"))
    rows = required.join(kept, entity, "left").select("truth_size", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("n", F.lit(0)).alias("n"))
    return rows.agg(F.avg(f05(F.col("tp"), F.col("n") - F.col("tp"), F.col("truth_size") - F.col("tp")))).first()[0]


def coordinate_ascent(labelled: DataFrame, required: DataFrame, start: dict[str, float] | float, gated: bool = False, rounds: int = 3, grid: Sequence[int] = GRID, entity: str = "s1_id", p: str = "p", margin: float = 1e-12) -> dict[str, float]:
    """Thresholds for S2, S3 (and an entity gate) by turns over the whole grid, a value adopted if it is better by ``margin``.

    Each turn is one :func:`sweep_levels`: a pair's level is the largest value
    of the moving threshold at which it is kept, the others as they stand. It
    ends early when a round changes nothing.
    """
    best_name = "x_best"
    rows = labelled.withColumn(best_name, F.max(p).over(Window.partitionBy(entity)))
    found = {"gate": 0.0, **({"s2": start, "s3": start} if isinstance(start, float) else start)}
    found = {name: float(found[name]) for name in ("gate", "s2", "s3")}
    always, never = F.lit(max(grid)), F.lit(min(grid) - 1)

    def scores(name: str) -> list[tuple[int, float]]:
        by_source = F.when(F.col("is_s2"), F.col(p) >= found["s2"]).otherwise(F.col(p) >= found["s3"])
        open_ = F.col(best_name) >= found["gate"]
        if name == "gate":
            level = F.when(by_source, _cell(F.col(best_name))).otherwise(never)
        else:
            moving = F.col("is_s2") if name == "s2" else ~F.col("is_s2")
            level = F.when(~open_, never).when(moving, _cell(F.col(p))).when(by_source, always).otherwise(never)
        got = sweep_levels(rows.select(entity, level.alias("level"), "label"), required, entity, grid).collect()  # one row a grid value
        return sorted((r["cell"], r["macro_f05"]) for r in got)

    best = macro(rows, required, F.when(F.col("is_s2"), F.col(p) >= found["s2"]).otherwise(F.col(p) >= found["s3"]) & (F.col(best_name) >= found["gate"]), entity)
    for _ in range(rounds):
        before = dict(found)
        for name in (("gate",) if gated else ()) + ("s2", "s3"):
            for cell, value in scores(name):
                if value > best + margin:
                    best, found[name] = value, cell / 100.0
        if found == before:
            break
    return found | {"macro_f05": best}


def floor_by_budget(tradeoff_rows: DataFrame, least_recall: float = 0.995) -> DataFrame:
    """P5: the largest floor whose share of true pairs kept is at least ``least_recall``; none without one."""
    return tradeoff_rows.where(F.col("recall_all_true_pairs") >= least_recall).agg(F.max_by(F.struct("floor", "candidates_per_entity", "recall_all_true_pairs"), "floor").alias("r")).where("r is not null").select("r.*")


def keep_share(scored: DataFrame, share: float = 0.9, most: int = 3, entity: str = "s1_id", p: str = "p", tie: str = "pool_id") -> DataFrame:
    """An entity's best new pairs, ``most`` at most, each with at least ``share`` of its best score."""
    own = Window.partitionBy(entity)
    rows = scored.withColumns({"x_top": F.max(p).over(own), "x_at": F.row_number().over(own.orderBy(F.col(p).desc(), tie))})
    return rows.where((F.col("x_at") <= most) & (F.col(p) >= share * F.col("x_top"))).drop("x_top", "x_at")


def tradeoff(labelled: DataFrame, required: DataFrame, floors: Sequence[float], score: str = "p", entity: str = "s1_id") -> DataFrame:
    """For each floor the candidates per entity, the share of true pairs kept and of entities left empty."""
    base = required.agg(F.count(F.lit(1)).alias("entities"), F.sum("truth_size").alias("truths"))
    per = labelled.groupBy(entity).agg(*[F.count(F.when(F.col(score) >= f, 1)).alias(f"n{i}") for i, f in enumerate(floors)], *[F.sum(F.when(F.col(score) >= f, F.col("label")).otherwise(0)).alias(f"t{i}") for i, f in enumerate(floors)])
    rows = F.array(*[F.struct(F.lit(float(f)).alias("floor"), F.sum(f"n{i}").alias("kept"), F.sum(f"t{i}").alias("true_kept"), F.count(F.when(F.col(f"n{i}") > 0, 1)).alias("covered")) for i, f in enumerate(floors)])
    flat = per.agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.*").crossJoin(F.broadcast(base))  # one row of totals
    return flat.select("floor", (F.col("kept") / F.col("entities")).alias("candidates_per_entity"), (F.col("true_kept") / F.nullif(F.col("truths"), F.lit(0))).alias("recall_all_true_pairs"), (1 - F.col("covered") / F.col("entities")).alias("entities_without_candidates"))


def recall_at(labelled: DataFrame, required: DataFrame, ks: Sequence[int] = (1, 3, 10, 20, 30), score: str = "p", entity: str = "s1_id", tie: str = "pool_id") -> DataFrame:
    """One row with the share of true pairs among each entity's best k."""
    placed = labelled.withColumn("x_at", F.row_number().over(Window.partitionBy(entity).orderBy(F.col(score).desc(), tie)))
    hits = placed.agg(*[F.sum(F.when(F.col("x_at") <= k, F.col("label")).otherwise(0)).alias(f"h{k}") for k in ks])
    return hits.crossJoin(F.broadcast(required.agg(F.sum("truth_size").alias("n")))).select(*[(F.col(f"h{k}") / F.col("n")).alias(f"recall_at_{k}") for k in ks])


def auc(labelled: DataFrame, score: str = "p") -> DataFrame:
    """Rank-sum AUC with mid-ranks, from counts by score value.

    Ranks run in two levels: over ranges of the score, 65,536 to the unit, and
    within each range, so no task sees all distinct scores.
    """
    by_value = labelled.groupBy(F.col(score).alias("v")).agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n")).withColumn("part", F.floor(F.col("v") * 65536))
    parts = by_value.groupBy("part").agg(F.sum("n").alias("m"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("r"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = by_value.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0))).join(parts, F.col("part") == F.col("r"))
    ranked = ranked.withColumn("mid", F.col("ahead") + F.col("inside") + (F.col("n") + 1) / 2.0)
    sums = ranked.agg(F.sum(F.col("pos") * F.col("mid")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return sums.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * (F.col("n") - F.col("p")).cast("double"))).alias("auc"))


def reduction_ratio(candidates: DataFrame, query: DataFrame, pool: DataFrame, group: str = "country") -> DataFrame:
    """Candidates against the cross product, by group; sizes come from counts, no pair is made."""
    parts = [df.groupBy(group).agg(F.count(F.lit(1)).alias(n)) for df, n in ((query, "n_query"), (pool, "n_pool"), (candidates, "n_pairs"))]
    rows = parts[0].join(parts[1], group).join(parts[2], group, "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))
    return rows.withColumn("reduction_ratio", 1 - F.col("n_pairs") / (F.col("n_query").cast("double") * F.col("n_pool")))
