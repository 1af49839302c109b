"""Files that arrive in a folder: new contents are appended to the clean events, and the metrics recomputed."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gold
from ..sources.ledger import fingerprints

CONTENTS = "path string, hash string, batch long"


def ingest_arrivals(spark: SparkSession, folder: str, schema: str, events: str, metrics: str, checkpoint: str, most_files: int = 1000) -> list[int]:
    """Takes in all Parquet files of a folder whose content no earlier call has seen, and returns the numbers of the batches
    that brought something new.

    The query's checkpoint remembers the files by name, in batches of `most_files`; a file is known by a hash of its
    bytes, so the same content under another name (or twice in a batch) is not loaded again. The hashes of a batch are
    kept beside the events, and both are written to directories named by the batch's number: one that is repeated after
    a failure replaces itself and looks only at the contents of earlier batches.
    """
    seen: list[int] = []

    def load(batch: DataFrame, number: int) -> None:
        paths = [r[0] for r in batch.select("_path").distinct().collect()]  # most_files of them at most
        if not paths:
            return
        first = fingerprints(spark, paths).groupBy("hash").agg(F.min("path").alias("path"))
        known = contents(spark, events).where(F.col("batch") < number).select("hash")
        first.join(known, "hash", "left_anti").write.mode("overwrite").parquet(f"{events}-contents/batch={number}")
        new = contents(spark, events).where(F.col("batch") == number).select(F.col("path").alias("_path"))
        if new.isEmpty():
            return
        batch.join(F.broadcast(new), "_path").drop("_path").write.mode("overwrite").parquet(f"{events}/batch={number}")
        seen.append(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder).select("*", F.col("_metadata.file_path").alias("_path"))
    query = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if seen:
        refresh(spark.read.parquet(events).drop("batch"), metrics)
    return seen


def contents(spark: SparkSession, events: str) -> DataFrame:
    """(path, hash, batch) of every content that was loaded, under the path that brought it first."""
    try:
        return spark.read.schema(CONTENTS).parquet(f"{events}-contents")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CONTENTS)


def refresh(events: DataFrame, metrics: str) -> None:
    """Recomputes the metric tables of events in full."""
    for name in ("daily_metrics", "merchant_metrics", "category_metrics", "user_metrics", "funnel_metrics"):
        getattr(gold, name)(events).write.mode("overwrite").parquet(f"{metrics}/{name}")
