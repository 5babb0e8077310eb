"""TSV and Parquet sources and sinks (S1-S13), truth lists (D12) and metadata checks."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "entity_id string, business_name string, business_address string, country string"


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder in the shared place that ``spark.checkpoint.dir`` names, deleted when the driver ends; where it is unset, a local one in local mode alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root or f"file://{tempfile.gettempdir()}/kinweave-scratch"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/kinweave-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, for results that several branches read."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated records with a header; an empty field is null."""
    return spark.read.csv(path, sep="\t", header=True, schema=RAW, quote="", escape="")


def read_truth(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """``s1_id, matched_ids``, empty lists kept as ''."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="s1_id string, matched_ids string", quote="", escape="").withColumn("matched_ids", F.coalesce("matched_ids", F.lit("")))
    return rows if ids is None else rows.join(ids.select("s1_id").distinct(), "s1_id", "left_semi")


def truth_pairs(lists: DataFrame) -> DataFrame:
    """``s1_id, pool_id`` of comma lists; singletons give no row."""
    return lists.where(F.col("matched_ids") != "").select("s1_id", F.explode(F.split("matched_ids", ",")).alias("pool_id"))


def write_lists(lists: DataFrame, path: str) -> None:
    """Unquoted TSV with a header."""
    lists.write.csv(path, sep="\t", header=True, quote="", emptyValue="", nullValue="")


def read_partition(spark: SparkSession, path: str, country: str, columns: list[str] | None = None) -> DataFrame:
    """One country's records; filter and columns reach the scan."""
    rows = spark.read.parquet(path).where(F.col("country") == country)
    return rows if columns is None else rows.select(*columns)


def lookup(df: DataFrame, ids: DataFrame, key: str, small_rows: int | None = None) -> DataFrame:
    """Rows whose key is listed; the list is broadcast where its caller knows it to be small."""
    wanted = ids.select(key).distinct()
    return df.join(F.broadcast(wanted) if small_rows is not None and small_rows <= 1_000_000 else wanted, key, "left_semi")


def build_cache(records: DataFrame, path: str) -> int:
    """Write by country under Spark's commit protocol and check the row count by reading back."""
    records.write.mode("overwrite").partitionBy("country").parquet(path)
    n, m = records.count(), records.sparkSession.read.parquet(path).count()
    if n != m:
        raise ValueError(f"{path} has {m} rows, not {n}")
    return n


def write_metadata(spark: SparkSession, path: str, meta: dict) -> None:
    """A small JSON document beside the data."""
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def check_metadata(spark: SparkSession, path: str, meta: dict) -> None:
    """Raise where the stored settings differ from those at hand."""
    found = json.loads(spark.read.text(path).first()["value"])
    if found != json.loads(json.dumps(meta)):
        changed = sorted(k for k in {*found, *meta} if found.get(k) != meta.get(k))
        raise ValueError(f"{path} was made with other settings: {', '.join(changed)}")


def hand_off(pairs: DataFrame, query: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct record texts ``rid, text`` and pairs of their ids, for scoring elsewhere; ids are hashes of the text."""
    from ..functions.text import serialize

    def text(df: DataFrame, key: str, side: str) -> DataFrame:
        return df.select("country", F.col("entity_id").alias(key), serialize(F.col("name_original"), F.col("address_original")).alias(f"text_{side}"))

    both = pairs.join(text(query, "s1_id", "1"), ["country", "s1_id"]).join(text(pool, "pool_id", "2"), ["country", "pool_id"])
    both = both.withColumns({f"rid_{s}": F.sha2(f"text_{s}", 256) for s in (1, 2)})
    records = both.select(F.col("rid_1").alias("rid"), F.col("text_1").alias("text")).unionByName(both.select(F.col("rid_2").alias("rid"), F.col("text_2").alias("text"))).dropDuplicates(["rid"])
    return records, both.select("country", "s1_id", "pool_id", "rid_1", "rid_2")
