"""Readers, lineage cutting and small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The columns of ``documents``.
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where that is unset and driver and executors are one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="chronoweave-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """The same rows from the checkpoint folder.

    The shuffle files of the step go as soon as it is written, by the setting ``SHUFFLE_CLEANUP``, which a plan takes up when it
    is made.  Otherwise executors keep them until the driver happens to collect that plan.  Collection still is asked for, as
    finished checkpoints and broadcasts go by it.
    """
    spark = df.sparkSession
    checkpoint_folder(spark)
    spark._jvm.System.gc()
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


#: Rows of a few numbers that one task handles with ease.
TASK_ROWS = 100_000
#: Texts, or pairs of them, that one task handles with ease.
TEXT_ROWS = 5_000


def sized(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """``df`` of about ``rows`` rows in no more partitions than those need, ``each`` in one, so that small steps write few files.

    For every file of a checkpoint the executors start a process or two that set its mode.
    """
    return df.coalesce(min(partitions(df.sparkSession), -(-rows // each) or 1))


def through_parquet(df: DataFrame, path: str | None = None) -> DataFrame:
    """The same rows, written to and read from a new folder (``path``, or one in the checkpoint folder)."""
    path = path or new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/stage-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: pandas types that keep whole numbers and truth values as they are beside nulls, where plain ones become floats and objects.
_WHOLE = {pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype(), pa.bool_(): pd.BooleanDtype()}


def map_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``df.mapInPandas(run, schema)``, with ids that stay exact in a batch that also holds a null."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in run(batch.to_pandas(types_mapper=_WHOLE.get) for batch in batches):
            yield from pa.Table.from_pandas(frame, schema=arrow, preserve_index=False).to_batches()

    return df.mapInArrow(go, schema)


def partitions(spark: SparkSession, least: int = 1) -> int:
    """The session's number of shuffle partitions."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def fold_of(doc_id: int | None, parts: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts
