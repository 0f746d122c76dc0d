"""Running and validating batches of statements."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.functions.cells import tag_of
from assayer.functions.statement import shape
from assayer.operators.capture import RESULT_ROWS, long_rows
from assayer.operators.ordered import attach
from assayer.session import in_pool, materialise, pooled, scratch, written_in_parts  # noqa: F401
from assayer.sources.database import run_query, schema_session

# The default time limit in seconds and the message for no rows.
STATEMENT_SECONDS = 10.0
EMPTY_RESULT = "Results are empty, which means SQL is wrong and does not answer the question."


class StatementTimeout(Exception):
    """The statement ran longer than its limit and its jobs were cancelled."""


def run_limited(spark: SparkSession, action: Callable[[], object], seconds: float | None = STATEMENT_SECONDS):
    """Run an action, planning included, in a scheduling pool of its own.

    When the time is up, the jobs it has started are cancelled, and again those it
    starts after that, until it returns; whatever it returns then is too late.
    """
    if not seconds:
        return action()
    context, tag = spark.sparkContext, f"limit-{uuid.uuid4().hex}"
    over, late = threading.Event(), threading.Event()

    def watch() -> None:
        if over.wait(seconds):
            return
        late.set()
        while not over.is_set():
            context.cancelJobsWithTag(tag)
            over.wait(0.1)

    watcher = threading.Thread(target=watch, daemon=True)
    earlier_pool = context.getLocalProperty("spark.scheduler.pool")
    context.addJobTag(tag)
    context.setLocalProperty("spark.scheduler.pool", tag)
    watcher.start()
    try:
        found = action()
    except Exception as exc:
        if late.is_set():
            raise StatementTimeout(f"statement exceeded {seconds} s") from exc
        raise
    finally:
        over.set()
        watcher.join()
        context.removeJobTag(tag)
        context.setLocalProperty("spark.scheduler.pool", earlier_pool)
    if late.is_set():
        raise StatementTimeout(f"statement exceeded {seconds} s")
    return found


def reason(exc: Exception) -> str:
    """A short, stable reason of a failed statement."""
    if isinstance(exc, StatementTimeout):
        return str(exc)
    if isinstance(exc, PySparkException) and exc.getCondition():
        return exc.getCondition()
    return f"{type(exc).__name__}: {exc}"


def check_statement(spark: SparkSession, sql: str, seconds: float | None = None) -> tuple[bool, str]:
    """(valid, reason) on the populated tables; a result without rows is not valid."""
    try:
        found = run_limited(spark, lambda: run_query(spark, sql).limit(1).count(), seconds)
    except Exception as exc:
        return False, reason(exc)
    return (True, "") if found else (False, EMPTY_RESULT)


def check_analysis(spark: SparkSession, sql: str) -> tuple[bool, str]:
    """(valid, reason) from analysis alone, for tables that only exist as a schema."""
    try:
        run_query(spark, sql).schema
    except Exception as exc:
        return False, reason(exc)
    return True, ""


def validate_sql(
    spark: SparkSession,
    statements: DataFrame,
    ddl: str | None = None,
    seconds: float | None = None,
    workers: int = 5,
) -> DataFrame:
    """(id, valid, err) for rows (id, sql); ids may repeat or be null, a null statement counts as an empty one.

    Without a DDL text equal statements run once. With one the statements are only
    analysed, on empty tables made from it in a session of their own: one statement of
    each shape, as literals that are compared don't matter there. Each of these has to
    be submitted from the driver; it takes a few at a time and writes the outcomes in
    parts, which are then joined to all rows.
    """
    text = F.coalesce("sql", F.lit(""))
    keyed = materialise(statements.select("id", text.alias("sql"), (text if ddl is None else shape(text)).alias("_key")))
    rows = materialise(keyed.groupBy("_key").agg(F.min("sql").alias("sql"))).toLocalIterator()
    if ddl is None:
        found = pooled(spark, rows, lambda r: (r._key, *check_statement(spark, r.sql, seconds)), workers)
    else:
        schema_only = schema_session(spark, ddl)
        found = pooled(spark, rows, lambda r: (r._key, *check_analysis(schema_only, r.sql)), workers)
    verdicts = written_in_parts(spark, found, "_key string, valid boolean, err string", "validity")
    return attach(keyed, verdicts, ["_key"], by=["id", "sql"]).select("id", "valid", "err")


def run_statements(
    spark: SparkSession,
    statements: Iterable,
    decimals: int | None = None,
    seconds: float | None = STATEMENT_SECONDS,
    workers: int = 5,
    sessions: dict[str, SparkSession] | None = None,
) -> DataFrame:
    """``result_rows`` of many statements (pair_id, side, alt, sql), each run once.

    ``sessions`` holds the session of each database that a statement may name in
    ``db_name``; without any, all run in ``spark``. Each result is written below
    the shared folder by its own jobs. Statement texts and errors pass through the
    driver, a few at a time.
    """
    root = scratch(spark, "results")

    def work(item):
        number, s = item
        own = sessions.get(s.db_name) if sessions else spark

        def run():
            if own is None:
                raise LookupError(f"no database {s.db_name}")
            df = run_query(own, s.sql, decimals)
            plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
            at = F.monotonically_increasing_id()
            rows = long_rows(plain, F.lit(s.pair_id), s.side, at, plain.columns, s.alt, names=df.columns)
            rows.write.parquet(f"{root}/statement={number}")
            return df

        try:
            df = run_limited(spark, run, seconds)
            return (s.pair_id, s.alt, s.side, None, list(df.columns), [tag_of(f.dataType) for f in df.schema.fields], None, None, number)
        except Exception as exc:
            return (s.pair_id, s.alt, s.side, None, [], [], None, reason(exc), None)

    done = pooled(spark, enumerate(statements), work, workers)
    outcomes = written_in_parts(spark, done, f"{RESULT_ROWS}, statement int", "outcomes")
    finished = outcomes.select("statement").where("statement IS NOT NULL")
    outcomes = outcomes.drop("statement")
    if finished.isEmpty():
        return outcomes
    written = spark.read.schema(f"{RESULT_ROWS}, statement int").parquet(root)
    return dense_positions(written.join(finished, "statement", "left_semi")).unionByName(outcomes)


def dense_positions(written: DataFrame) -> DataFrame:
    """Replace the partition-wise row numbers of written results by 0, 1, 2, ..."""
    tagged = written.withColumn("_part", F.shiftright("pos", 33))
    sizes = tagged.groupBy("statement", "_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy("statement").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(
        sizes.select("statement", "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    )
    placed = attach(tagged, starts, ["statement", "_part"], by=["pos"])
    local = F.col("pos").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("pos", F.col("_start") + local).drop("_start", "_part", "statement")


def generate(prompts: DataFrame, generator: Callable, schema: str) -> DataFrame:
    """Apply a user's generator to batches of prompts inside the tasks."""
    return prompts.mapInPandas(generator, schema)


def recorded_responses(questions: DataFrame, responses: DataFrame) -> DataFrame:
    """Attach recorded answers by (qid, model); a missing answer leaves NULLs."""
    keys = [k for k in ("qid", "model") if k in questions.columns]
    return questions.join(responses, keys, "left")
