"""Scoring finished results as they arrive.

A result is delivered in parts: rows of ``result_rows`` with the number of their
part, every part whole in one file, and a marker row that says how many parts the
result has and how many results its side of the pair. Parts and markers may come in
any order, over any number of files, and more than once.

The stream keeps, for each pair, which parts have come and in which file, not the
rows. Once both sides of a pair are complete, its parts leave the state and the
batch scores the pair from the files, like any stored table; what is delivered
again later is known by the pair and ignored. Batches are written by number, so
one that is repeated after a failure replaces what it left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assayer.operators.capture import RESULT_ROWS
from assayer.operators.ordered import attach
from assayer.operators.score import result_heads, score_pairs
from assayer.session import materialise
from assayer.streaming.live import watch_results

#: ``part`` numbers the part of a row; a marker row has none, but ``parts`` and ``results``.
DELIVERED = f"{RESULT_ROWS}, part int, parts int, results int"
SCORES = "pair_id bigint, exact boolean, correct boolean, exact_alt int, failed boolean, error string"
_PARTS = "pair_id bigint, result int, part int, file string"
_ARRIVED = "pair_id bigint, result int, part int, parts int, results int, file string"
_STATE = "done boolean, golds int, result array<int>, parts array<int>, of array<int>, part array<int>, file array<string>"
GENERATED, MARKER = -1, -1


def with_markers(result_rows: DataFrame, rows_per_part: int = 100_000) -> DataFrame:
    """``result_rows`` as they are delivered: rows numbered by part and a marker for each result.

    Rows are numbered from 0 in ``pos``. A result without rows and a failed one
    are markers alone. ``result_rows`` is read twice.
    """
    heads = result_heads(result_rows)
    results = heads.groupBy("pair_id", "side").agg(F.count(F.lit(1)).cast("int").alias("results"))
    markers = heads.join(results, ["pair_id", "side"]).select(
        "pair_id", "alt", "side", F.lit(None).cast("bigint").alias("pos"), "names", "tags",
        F.lit(None).cast(result_rows.schema["vals"].dataType).alias("vals"), "err", F.lit(None).cast("int").alias("part"),
        F.ceil(F.col("rows") / rows_per_part).cast("int").alias("parts"), "results",
    )
    rows = result_rows.filter("pos IS NOT NULL").withColumns(
        {"part": F.floor(F.col("pos") / rows_per_part).cast("int"), "parts": F.lit(None).cast("int"), "results": F.lit(None).cast("int")}
    )
    return rows.unionByName(markers)


def deliver(delivered: DataFrame, folder: str, files: int) -> None:
    """Add files to a watched folder, each part and each marker whole in one of them."""
    dealt = delivered.repartition(files, "pair_id", "side", "alt", "part")
    dealt.write.mode("append").parquet(folder)


def arrived_parts(rows: DataFrame) -> DataFrame:
    """Which parts and markers the rows hold, each once for a task and file; reads no cells."""
    result = F.when(F.col("side") == "gold", F.coalesce("alt", F.lit(0))).otherwise(GENERATED)
    named = rows.select(
        "pair_id", result.cast("int").alias("result"), F.coalesce("part", F.lit(MARKER)).cast("int").alias("part"),
        F.coalesce("parts", F.lit(-1)).alias("parts"), F.coalesce("results", F.lit(-1)).alias("results"), F.col("_metadata.file_path").alias("file"),
    )

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # rows of a part follow each other in its file
        for batch in batches:
            kept = []
            for i, row in enumerate(zip(*(column.to_pylist() for column in batch.columns), strict=True)):
                if row != last:
                    kept.append(i)
                last = row
            yield batch.take(pa.array(kept, pa.int64()))

    return named.mapInArrow(once, _ARRIVED)


def _missing(golds: int, counts: dict[int, int], parts: dict[tuple[int, int], str]) -> bool:
    wanted = [GENERATED, *range(golds)]
    if golds <= 0 or any(result not in counts for result in wanted):
        return True
    held = dict.fromkeys(wanted, 0)
    for result, part in parts:
        if result in held and part != MARKER and part < counts[result]:
            held[result] += 1
    return any(held[result] < counts[result] for result in wanted)


def _held(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The parts of a pair once all have come; before that and afterwards nothing."""
    done, golds, counts, parts = False, -1, {}, {}
    if state.exists:
        done, golds, result, number, of, part, file = state.get
        counts = dict(zip(result, number, strict=True))
        parts = dict(zip(zip(of, part, strict=True), file, strict=True))
    for frame in frames:
        for row in frame.itertuples(index=False):
            if row.part == MARKER:
                counts[int(row.result)] = int(row.parts)
                if row.result != GENERATED:
                    golds = int(row.results)
            parts.setdefault((int(row.result), int(row.part)), row.file)
    if not done and not _missing(golds, counts, parts):
        rows = [(int(key[0]), result, part, file) for (result, part), file in parts.items()]
        yield pd.DataFrame(rows, columns=["pair_id", "result", "part", "file"])
        done = True
    if done:
        state.update((True, golds, [], [], [], [], []))
    else:
        state.update((False, golds, list(counts), list(counts.values()), [r for r, _ in parts], [p for _, p in parts], list(parts.values())))


def complete_pairs(rows: DataFrame) -> DataFrame:
    """A stream of (pair_id, result, part, file): all parts of a pair in the batch that completes it."""
    return arrived_parts(rows).groupBy("pair_id").applyInPandasWithState(
        _held, _PARTS, _STATE, "append", GroupStateTimeout.NoTimeout
    )


def _rows_of(spark: SparkSession, parts: DataFrame) -> DataFrame:
    """The ``result_rows`` of parts, each from the file in which it came first."""
    files = [r.file for r in parts.select("file").distinct().toLocalIterator()]  # as the reader needs them
    result = F.when(F.col("side") == "gold", F.coalesce("alt", F.lit(0))).otherwise(GENERATED).cast("int")
    read = spark.read.schema(DELIVERED).parquet(*files).withColumns(
        {"result": result, "part": F.coalesce("part", F.lit(MARKER)), "file": F.col("_metadata.file_path")}
    )
    rows = attach(read, parts, ["pair_id", "result", "part", "file"], by=["pos"], how="left_semi")
    return rows.drop("result", "part", "parts", "results", "file")


def score_arrivals(
    spark: SparkSession, folder: str, questions: DataFrame, path: str, checkpoint: str, files_per_batch: int = 1, order_parse: str = "faithful"
) -> StreamingQuery:
    """Score each pair of ``questions`` in the batch that completes it, working off what is there and ending.

    Scores (``SCORES``) are written below ``path``/scores by batch. Started again
    with the same checkpoint it goes on where it ended, also in the middle of a
    batch. Files have to stay in ``folder`` until the run is over. Pairs without
    a question are not scored; a pair that never becomes complete stays in the state.
    """
    rows = watch_results(spark, folder, DELIVERED, "parquet", files_per_batch=files_per_batch)

    def score(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        stored = f"{path}/complete/batch={number}"
        batch.write.mode("overwrite").parquet(stored)
        parts = own.read.schema(_PARTS).parquet(stored)
        target = f"{path}/scores/batch={number}"
        if parts.isEmpty():
            own.createDataFrame([], SCORES).write.mode("overwrite").parquet(target)
            return
        asked = questions.join(parts.select("pair_id").distinct(), "pair_id", "left_semi")
        scores = score_pairs(materialise(_rows_of(own, parts)), asked, order_parse)
        scored = scores.join(asked.select("pair_id"), "pair_id", "left_semi")
        names = [field.split()[0] for field in SCORES.split(", ")]
        scored.select(*names).write.mode("overwrite").parquet(target)

    return (
        complete_pairs(rows)
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(score)
        .trigger(availableNow=True)
        .start()
    )


def arrived_scores(spark: SparkSession, path: str) -> DataFrame:
    """All scores so far, with the batch in which their pair was completed."""
    return spark.read.schema(f"{SCORES}, batch bigint").parquet(f"{path}/scores")
