"""Live runs: picking up result files, running rates, appending to the store."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assayer.session import materialise
from assayer.sources.store import PROMPT_FIELDS, batch_path, store_rows, unseen_prompts


def watch_results(
    spark: SparkSession, folder: str, schema: str, fmt: str = "csv", archive: str | None = None, files_per_batch: int = 1
) -> DataFrame:
    """A stream of the rows of new files, oldest first, each file read once.

    With ``archive`` a file moves there once a later batch has been finished.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=True, comment="#", escape='"')
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.format(fmt).load(folder)


def collect_results(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the watched rows to a table, processing what is there and ending."""
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def live_accuracy(rows: DataFrame) -> DataFrame:
    """Rows and mean correctness per category, kept up to date while rows arrive."""
    return rows.groupBy("query_category").agg(
        F.count(F.lit(1)).alias("tried"), F.sum("correct").alias("right"), F.avg("correct").alias("mean_correct")
    )


def hourly_sums(rows: DataFrame, ts: str) -> DataFrame:
    """Per hour, how many rows there are and how many are correct: sums that can be added up."""
    hour = F.date_trunc("hour", ts).alias("hour")
    return rows.groupBy(hour).agg(F.count(F.lit(1)).alias("tried"), F.sum(F.col("correct").cast("bigint")).alias("right"))


_SUMS = "hour TIMESTAMP, tried BIGINT, `right` BIGINT, stream STRING, batch BIGINT"


def publish_hourly(rows: DataFrame, ts: str, path: str, checkpoint: str) -> StreamingQuery:
    """Add the sums of every batch to the hourly report below ``path``; rows may be late by any time.

    Nothing waits for a watermark: a late row adds to its hour like any other. A
    batch is written by its number and the stream by its checkpoint, so a batch
    that is repeated replaces itself, and several streams may share a report.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        hourly_sums(batch, ts).write.mode("overwrite").parquet(f"{path}/sums/stream={stream}/batch={number}")

    return (
        rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    )


def _folded(spark: SparkSession, path: str) -> DataFrame | None:
    """What ``fold_hourly`` wrote last for each stream; null if it never ran."""
    try:
        folded = spark.read.schema(_SUMS).parquet(f"{path}/folded")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = folded.groupBy("stream").agg(F.max("batch").alias("batch"))
    return folded.join(F.broadcast(last), ["stream", "batch"])  # one row for each stream


def _sums(spark: SparkSession, path: str) -> DataFrame:
    """Folded sums and those of the batches that came after."""
    sums, folded = spark.read.schema(_SUMS).parquet(f"{path}/sums"), _folded(spark, path)
    if folded is None:
        return sums
    upto = folded.select("stream", F.col("batch").alias("upto")).distinct()
    later = sums.join(F.broadcast(upto), "stream", "left").filter("upto IS NULL OR batch > upto").drop("upto")
    return folded.unionByName(later)


def hourly_accuracy(spark: SparkSession, path: str) -> DataFrame:
    """Rows and mean correctness per hour of all that has been published."""
    total = _sums(spark, path).groupBy("hour").agg(F.sum("tried").alias("tried"), F.sum("right").alias("right"))
    return total.select("hour", "tried", (F.col("right") / F.col("tried")).alias("mean_correct"))


def fold_hourly(spark: SparkSession, path: str) -> None:
    """Fold all batches but the last of each stream, which may still be repeated, into one row for each hour.

    Readers skip what is folded. A fold is written under the number of its last
    batch, so a repeated one replaces itself.
    """
    last = spark.read.schema(_SUMS).parquet(f"{path}/sums").groupBy("stream").agg((F.max("batch") - 1).alias("upto"))
    ready = _sums(spark, path).join(F.broadcast(last), "stream").filter("batch <= upto")
    folded = ready.groupBy("stream", F.col("upto").alias("batch"), "hour").agg(F.sum("tried").alias("tried"), F.sum("right").alias("right"))
    stored = materialise(folded)  # what is overwritten may be among what is read
    stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream", "batch").parquet(f"{path}/folded")


def publish(report: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Write the report of every batch, whole or (``update``) what has changed, to its own folder below ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        report.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )


def append_to_store(
    rows: DataFrame, eval_path: str, prompt_path: str, checkpoint: str, parameters: dict
) -> StreamingQuery:
    """Append each batch to the run store and its unseen prompts to the prompt table.

    A batch writes below its run and its number, so a batch that is repeated after
    a failure replaces what it wrote before, and nothing of another run. A run id
    belongs to one stream.
    """
    if not parameters.get("run_id"):
        raise ValueError("a stream needs the run_id of its rows")
    run = parameters["run_id"]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store_rows(batch, parameters).write.mode("overwrite").parquet(batch_path(eval_path, run, number))
        known = spark.read.schema(f"{PROMPT_FIELDS}, run STRING, batch BIGINT").parquet(prompt_path)
        earlier = known.filter((F.col("run") != run) | (F.col("batch") < number))
        unseen = unseen_prompts(batch.select("prompt_id", "prompt"), earlier)
        unseen.write.mode("overwrite").parquet(batch_path(prompt_path, run, number))

    return (
        rows.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
