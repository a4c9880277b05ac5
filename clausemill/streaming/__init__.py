"""Streaming ingest: new markdown files become structure tables as they arrive (an addition to the batch engine)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clausemill.operators.extract import split_lines
from clausemill.operators.structure import build_structure
from clausemill.sources.readers import stem_of
from clausemill.sources.writers import write_step


def stream_lines(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """stem, line_no, raw of files as they arrive."""
    files = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return split_lines(files.select(stem_of(F.input_file_name()).alias("stem"), F.col("value").alias("text"))).select("stem", F.col("line_no").cast("long").alias("line_no"), "raw")


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] = build_structure, once: bool = True) -> StreamingQuery:
    """Write step(lines) of each micro-batch to a table by stem.  A batch that is repeated replaces its own documents, so each counts once."""
    writer = stream_lines(spark, folder).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: write_step(step(batch), table))
    return (writer.trigger(availableNow=True) if once else writer).start()
