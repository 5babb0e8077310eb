"""Shared helpers: tables, scratch storage that outlives executors, name clashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join with at most this many narrow rows may be broadcast; the driver holds it several times while it builds it.
BROADCAST_ROWS = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a local one only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"file://{tempfile.gettempdir()}/kinweave-scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/kinweave-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage, safe from lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete what :func:`cut` wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_kept: dict[str, Callable[[], None]] = {}


def keep_in_worker(owner: str, drop: Callable[[], None]) -> None:
    """Note that this worker keeps something of ``owner`` between tasks, and how to drop it."""
    _kept[owner] = drop


def drop_kept(but: str = "") -> None:
    """Drop what this worker keeps of other operators than ``but`` and give free memory back: a stage after another finds its worker as new."""
    for owner in [x for x in _kept if x != but]:
        _kept.pop(owner)()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Names near ``wanted`` that no column of ``df`` bears, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_with(df: DataFrame, added: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """The columns of ``df`` (or ``keep``), then ``added``; an added name replaces an input column of that name."""
    names = {c.lower() for c in added}
    kept = [F.col(f"`{c}`") for c in (df.columns if keep is None else keep) if c.lower() not in names]
    return df.select(*kept, *[v.alias(k) for k, v in added.items()])


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a join's side of narrow rows, marked for broadcast if its counted ``rows`` are within ``BROADCAST_ROWS``, else for hashing by partition: the other side isn't sorted."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("shuffle_hash")


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, mod ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus
