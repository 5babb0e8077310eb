"""Incremental linkage: query records arrive as a stream, the pool is a table.

Each micro-batch runs the batch operators; results are written under the
batch's id, so a batch that is replayed after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import normalize_records
from ..operators.blocking import Config, block, records


def link_stream(raw: DataFrame, pool: DataFrame, out: str, checkpoint: str, cfg: Config = Config()) -> StreamingQuery:
    """``raw`` is a stream of raw records, ``pool`` normalised ones; candidates go to ``out/batch_id=n``."""

    def link(batch: DataFrame, batch_id: int) -> None:
        found = block(records(normalize_records(batch)), records(pool), cfg)
        found.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return raw.writeStream.foreachBatch(link).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
