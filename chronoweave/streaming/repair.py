"""Repair of labelled documents as they arrive.

A document is complete in itself, so a stream needs no state and no watermark: each micro-batch is repaired like a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from chronoweave.operators.energy import icm_repair

EDGES = "doc long, s long, t long, rel string"


def read_edges(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Edges of whole documents from Parquet files that appear in a folder; a document's edges are in one file."""
    return spark.readStream.schema(EDGES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def repair_stream(edges: DataFrame, prior: DataFrame, channel: DataFrame, information: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Writes ``(doc, s, t, obs, best, sweep)`` of every batch to ``out`` once; ends when the folder is read."""

    def one(batch: DataFrame, number: int) -> None:
        icm_repair(batch, prior, channel, information, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return edges.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
