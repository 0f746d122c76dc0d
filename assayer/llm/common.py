"""Helpers that several of the training-text operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.wordhash import forget_powers
from assayer.session import scratch, table

#: Bytes between words: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


#: Rows and bytes of one Arrow batch between the JVM and Python: texts are large, and a batch is held by both sides at once.
#: A single row may be larger.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def in_small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, after lowering the session's size of Arrow batches to what texts allow."""
    conf, rows, size = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, str(BATCH_ROWS))
    held = conf.get(size).rstrip("bB")
    if not held.isdigit() or int(held) > BATCH_BYTES:
        conf.set(size, str(BATCH_BYTES))
    return docs


def release() -> None:
    """Give memory that is free back to the system: a Python worker lives on and is used by later stages."""
    forget_powers()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


#: What ``kept_by_worker`` made.
_KEPT: list[Callable] = []


def kept_by_worker(make: Callable) -> Callable:
    """``make``, whose last result a Python worker keeps from task to task, until one runs in it that doesn't use it."""
    kept = lru_cache(maxsize=1)(make)
    _KEPT.append(kept)
    return kept


def forget_all_but(*used: Callable) -> None:
    for kept in _KEPT:
        if kept not in used:
            kept.cache_clear()


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *used: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on the batches of a task, releasing what it held at its end.

    Of the tables that the worker keeps those ``used`` stay; others are of stages that went before.
    """

    @wraps(work)
    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_all_but(*used)
        try:
            yield from work(batches)
        finally:
            release()

    return through


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, null texts as empty ones, whatever other columns there are."""
    return in_small_batches(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def pinned(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and makes every later
    stage see the same rows.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_fold(id_column: Column, folds: int, fold: int) -> Column:
    """Is crc32(id as text) mod ``folds`` equal to ``fold``? A null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds == fold


def with_class(members: DataFrame, keys: list[str], id_col: str, least: str, repeated_only: bool = False) -> DataFrame:
    """Attach the least id of all members with equal keys, however many share them.

    ``repeated_only`` leaves out members whose class has one id only. ``members``
    should be stored, it is read several times.
    """
    classes = members.groupBy(*keys).agg(F.min(id_col).alias(least), F.max(id_col).alias("_most"), F.count(F.lit(1)).alias("_n"))
    if repeated_only:
        classes = classes.where(F.col(least) < F.col("_most"))
    return attached(members, pinned(classes.drop("_most"), "classes"), keys, "_n")


def attached(members: DataFrame, classes: DataFrame, keys: list[str], size: str, slices: int = 1000) -> DataFrame:
    """Members with the columns of their class; members without a class are left out.

    Classes whose ``size`` is more than 1/``slices`` of all members (there are at
    most ``slices``) are broadcast, so their members are not gathered; the others
    are joined by shuffle. Both sides should be stored.
    """
    total = members.count()
    heavy = (F.col(size) * slices > total) & (F.col(size) > 64)
    warm = members.join(F.broadcast(classes.where(heavy).drop(size)), keys)
    cold = members.join(F.broadcast(classes.where(heavy).select(*keys)), keys, "left_anti").join(classes.where(~heavy).drop(size), keys)
    return warm.unionByName(cold)
