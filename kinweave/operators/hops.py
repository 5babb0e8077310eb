"""Second-hop retrieval (C7), new-pair union and filter features (C10, A7, M8), world cuts (C8) and dense search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity
from .blocking import Config, block
from .blocking import records as blocking_records


def anchors(pairs: DataFrame, least: float = 0.9, most: int = 3, entity: tuple[str, ...] = ("country", "s1_id"), q: str = "q") -> DataFrame:
    """Each entity's best candidates of confidence ``least`` or more."""
    place = F.row_number().over(Window.partitionBy(*entity).orderBy(F.col(q).desc(), "pool_id"))
    return pairs.where(F.col(q) >= least).withColumn("x_at", place).where(F.col("x_at") <= most).select(*entity, F.col("pool_id").alias("anchor_id"), F.col(q).alias("hop_conf"))


def second_hop(anchor: DataFrame, existing: DataFrame, pool: DataFrame, cfg: Config = Config(), top: int = 10) -> DataFrame:
    """What anchors retrieve from the pool as if they were queries, without themselves and known pairs.

    ``hop_rank`` is the best retrieval score, ``hop_conf`` the confidence of
    its anchor, ``hop_n`` the anchors that found it; the ``top`` best stay. An
    anchor shared by several entities is looked up once.
    """
    looked_up = blocking_records(pool).join(anchor.select("country", F.col("anchor_id").alias("id")).distinct(), ["country", "id"], "left_semi")
    found = block(looked_up, blocking_records(pool), cfg).select("country", F.col("s1_id").alias("anchor_id"), "pool_id", "rank_score")
    reached = anchor.join(found, ["country", "anchor_id"]).where(F.col("pool_id") != F.col("anchor_id"))
    reached = reached.join(existing.select("country", "s1_id", "pool_id").distinct(), ["country", "s1_id", "pool_id"], "left_anti")
    best = F.max(F.struct(F.round("rank_score", 9).alias("r"), F.col("hop_conf").alias("c")))
    pairs = reached.groupBy("country", "s1_id", "pool_id").agg(best.alias("b"), F.count(F.lit(1)).alias("hop_n")).select("country", "s1_id", "pool_id", F.col("b")["r"].alias("hop_rank"), F.col("b")["c"].alias("hop_conf"), "hop_n")
    place = F.row_number().over(Window.partitionBy("country", "s1_id").orderBy(F.col("hop_rank").desc(), "pool_id"))
    return pairs.withColumn("x_at", place).where(F.col("x_at") <= top).drop("x_at")


def union_sources(dense: DataFrame | None, hop: DataFrame | None, keys: tuple[str, ...] = ("s1_id", "pool_id")) -> DataFrame:
    """One row a pair of either source: flags, best scores, nulls where a source is silent."""
    sides = [df.withColumn(flag, F.lit(1)) for df, flag in ((dense, "src_dense"), (hop, "src_hop")) if df is not None]
    both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1], allowMissingColumns=True)
    for c, kind in (("src_dense", "int"), ("src_hop", "int"), ("dense_score", "double"), ("dense_rank", "int"), ("hop_rank", "double"), ("hop_conf", "double"), ("hop_n", "long")):
        if c not in both.columns:
            both = both.withColumn(c, F.lit(None).cast(kind))
    return both.groupBy(*keys).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("src_dense", "src_hop")], F.max("dense_score").alias("dense_score"), F.min("dense_rank").alias("dense_rank"), *[F.max(c).alias(c) for c in ("hop_rank", "hop_conf", "hop_n")])


def new_pair_features(rows: DataFrame) -> DataFrame:
    """M8 of pairs with normalised ``name_1, name_2, addr_1, addr_2`` and ``name_script_2``; empty sides keep the scorer's own value."""
    for n, c in (("name", "name"), ("addr", "addr")):
        sims = similarity.scores(F.col(f"{c}_1"), F.col(f"{c}_2"), ("token_set", "ratio"), empty_is_null=False)
        rows = rows.withColumn("x_s", sims).withColumns({f"nf_{n}_set": F.col("x_s")["token_set"], f"nf_{n}_ratio": F.col("x_s")["ratio"]}).drop("x_s")
    return rows.withColumns({"nf_addr_empty": (F.length("addr_2") == 0).cast("int"), "nf_name_nonlatin": (~F.col("name_script_2").isin("latin", "latin_accent")).cast("int")})


def extend_candidates(first: DataFrame, new: DataFrame, score: str = "new_score", keys: tuple[str, ...] = ("country", "s1_id", "pool_id")) -> DataFrame:
    """First-hop candidates and new pairs with zero evidence; ``filter_score`` of a new pair is its own score. Repeats raise."""
    grown = new.withColumn("filter_score", F.col(score)).withColumn("is_new", F.lit(1))
    both = first.withColumn("is_new", F.lit(0)).unionByName(grown, allowMissingColumns=True)
    numbers = [f.name for f in both.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float") and f.name not in keys]
    both = both.fillna(0, subset=numbers)
    times = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return both.withColumn("x_n", F.when(times > 1, F.raise_error(F.lit("a new pair is a candidate already"))).otherwise(times)).where(F.col("x_n") >= 1).drop("x_n")


def override(scores: DataFrame, oof: DataFrame, column: str = "p", keys: tuple[str, ...] = ("s1_id", "pool_id")) -> DataFrame:
    """Out-of-fold scores in place of the model's where there are any."""
    other = oof.dropDuplicates(list(keys)).select(*keys, F.col(column).alias("x_oof"))
    return scores.join(other, list(keys), "left").withColumn(column, F.coalesce("x_oof", column)).drop("x_oof")


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def dense_search(query: DataFrame, pool: DataFrame, k: int = 30, group: str = "label", block_rows: int = 4096) -> DataFrame:
    """Exact cosine neighbours ``q_id, p_id, dense_score, dense_rank`` within ``group``.

    ``query`` and ``pool`` have ``id, group, vec``. The query set is stated.
    Both sides are cut into lists of about ``block_rows`` vectors of a group;
    two lists meet as one matrix product and keep each query's best ``k``, so
    what leaves the product is k rows a query, not pairs.
    """
    import numpy as np
    import pyarrow as pa

    q_type = query.schema["id"].dataType.simpleString()

    def packed_rows(df: DataFrame, side: str) -> DataFrame:
        # lists of about ``block_rows`` vectors, however large a group is
        sizes = df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("lists"))
        rows = df.join(sizes, group).withColumn("part", F.pmod(F.xxhash64("id"), F.col("lists")))
        return rows.groupBy(group, "part").agg(F.collect_list("id").alias(f"{side}_ids"), F.collect_list("vec").alias(f"{side}_vecs")).drop("part")

    packed, meet = packed_rows(query, "q"), packed_rows(pool, "p")

    def unit(vectors: list) -> np.ndarray:
        m = np.array(vectors, np.float64)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def best(batches):
        for batch in batches:
            kind = batch.schema.field("q_ids").type.value_type
            for row in batch.to_pylist():
                sims = unit(row["q_vecs"]) @ unit(row["p_vecs"]).T
                ids = np.array(row["p_ids"])
                out = {"q_id": [], "p_id": [], "dense_score": []}
                for i, q in enumerate(row["q_ids"]):
                    order = [j for j in np.lexsort((ids, -np.round(sims[i], 12))) if row["p_ids"][j] != q][:k]
                    out["q_id"] += [q] * len(order)
                    out["p_id"] += [row["p_ids"][j] for j in order]
                    out["dense_score"] += sims[i][order].tolist()
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("q_id", kind), ("p_id", kind), ("dense_score", pa.float64())]))

    found = packed.join(meet, group).select("q_ids", "q_vecs", "p_ids", "p_vecs").mapInArrow(best, f"q_id {q_type}, p_id {q_type}, dense_score double")
    place = F.row_number().over(Window.partitionBy("q_id").orderBy(F.round("dense_score", 12).desc(), "p_id"))
    return found.withColumn("dense_rank", place).where(F.col("dense_rank") <= k)
