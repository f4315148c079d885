"""Incremental triage: a stream of files, each judged as batch triage judges it, with verdicts kept by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomdoc.operators.intake import triage
from loomdoc.sources.filetree import SCHEMA, FileTree

VERDICTS = "path string, hash string, size bigint, verdict string, reason string, n_hits bigint, first_hit string, error string, batch int"


def file_stream(spark: SparkSession, path: str, seen: str) -> DataFrame:
    """New and changed files below path, hidden, empty and unreadable ones too. seen: a folder for the lists of what was found."""
    spark.dataSource.register(FileTree)
    return spark.readStream.format("file_tree").schema(SCHEMA).option("path", path).option("seen", seen).load()


def queued(spark: SparkSession, out: str, before: int) -> DataFrame:
    """hash of what the batches before put in the queue. Junk, files in the manifest and unreadable ones are in none."""
    try:
        rows = spark.read.schema(VERDICTS).parquet(out)
    except AnalysisException:  # no batch was written yet
        return spark.createDataFrame([], "hash string")
    return rows.where((F.col("batch") < before) & F.col("verdict").isin("duplicate", "content")).select("hash").distinct()


def triage_stream(files: DataFrame, manifest: DataFrame, home: DataFrame, out: str, checkpoint: str, interval: str | None = None, notify: Callable[[int, int], None] | None = None, quarantine: str | None = None) -> StreamingQuery:
    """Judge each file and append the verdicts to out, a folder for each batch, so that a batch that runs again replaces itself.

    The state is what earlier batches queued, read from out: a hash is queued once, while every junk file is judged as such. interval:
    such as "15 minutes"; without it the stream takes what is there and ends. notify: gets the batch and its rows.
    """
    spark = files.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        rows = batch.where("not skipped").persist()
        try:
            judged = triage(rows.select("path", "hash", "size"), manifest, queued(spark, out, number), home, quarantine)
            judged.join(rows.select("path", "error"), "path").write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            rows.unpersist()
        if notify:
            notify(number, spark.read.parquet(f"{out}/batch={number}").count())

    writer = files.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
