"""Session helpers: building a session, loading tables, shared scratch folders."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(app: str = "assayer", cores: str = "*", partitions: int | None = None) -> SparkSession:
    """A local session with the settings the engine is tested with.

    ``partitions`` of shuffles: as many as cores unless given. On a cluster these
    settings are the cluster's own. Statements run in FAIR pools of their own.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or (os.cpu_count() if cores == "*" else cores)))
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Of rows that ``spread`` deals to one task, where their number is known.
ROWS_A_TASK = 10_000


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """``df`` dealt by ``keys`` over several tasks a core, for work that takes long for each row.

    A table of short rows may be one file or row group, which one task reads,
    whatever each of its rows takes. The number of tasks is given, as the rows'
    bytes, which Spark would go by, say nothing of that time. It grows with
    ``rows``, if given, so that what a task holds does not.
    """
    spark = df.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))
    return df.repartition(parts, *keys)


#: By application, where a local master has no folder named; removed when the process ends.
_FALLBACKS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACKS:
        _FALLBACKS[app] = tempfile.mkdtemp(prefix="assayer-")
        atexit.register(shutil.rmtree, _FALLBACKS[app], ignore_errors=True)
    return _FALLBACKS[app]


def scratch(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage.

    The copy survives the loss of executors and pins values, such as partition
    numbers, that a recomputation could change.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def in_pool(spark: SparkSession, items: Iterable, work: Callable, workers: int = 5) -> list:
    """Submit one piece of work per item from a few threads; results in input order."""
    return list(pooled(spark, items, work, workers))


def pooled(spark: SparkSession, items: Iterable, work: Callable, workers: int = 5) -> Iterator:
    """As ``in_pool``, result by result; no more than four items per thread are taken ahead."""
    target, waiting = inheritable_thread_target(spark)(work), deque()
    with ThreadPoolExecutor(max_workers=workers) as pool:
        for item in items:
            waiting.append(pool.submit(target, item))
            if len(waiting) >= 4 * workers:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()


def written_in_parts(spark: SparkSession, rows: Iterable, schema: str, label: str, size: int = 500) -> DataFrame:
    """A table of rows the driver makes one after the other; it never holds more than ``size`` of them."""
    path, rows = scratch(spark, label), iter(rows)
    spark.createDataFrame([], schema).write.parquet(f"{path}/part=-1")
    number = 0
    while part := list(islice(rows, size)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/part={number}")
        number += 1
    return spark.read.schema(schema).parquet(path).drop("part")
