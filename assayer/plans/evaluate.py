"""A whole evaluation run: questions and answers in, scored run rows out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.textops import CLEANERS
from assayer.operators.expand import expand_gold
from assayer.operators.outcome import EXECUTION_ERROR, outcome_columns
from assayer.operators.score import score_pairs
from assayer.plans.execute import run_statements
from assayer.session import materialise
from assayer.sources.database import database_session, sessions_of


@dataclass(frozen=True)
class RunOptions:
    """What differs between the ways answers are produced and recorded."""

    cleaner: str = "first_fence"
    decimals: int | None = None
    seconds: float | None = 10.0
    workers: int = 5
    order_parse: str = "faithful"
    execution_prefix: str = EXECUTION_ERROR
    mark_incorrect: bool = True
    legacy_flags: bool = False


def evaluate_run(
    spark: SparkSession,
    questions: DataFrame,
    responses: DataFrame,
    databases: str | dict[str, str] | None,
    options: RunOptions = RunOptions(),
) -> DataFrame:
    """Score one run.

    ``databases`` names for each ``db_name`` a folder of tables or a DDL text;
    every one gets a session of its own. A single folder serves all questions, and
    without any the statements run on the views of ``spark``. A question whose
    database isn't named fails when its statements are run.

    ``questions`` has ``qid, db_name, query_category, question, query`` and any
    further columns; ``responses`` has ``qid, content`` and optionally
    ``generation_error, timed_out, latency_seconds, tokens_used``. Statements
    are submitted from the driver; their results never pass through it.
    """
    if isinstance(databases, str):
        names = [r.db_name for r in questions.select("db_name").distinct().toLocalIterator()]
        shared = database_session(spark, databases)
        sessions = dict.fromkeys(names, shared)
    else:
        sessions = sessions_of(spark, databases or {})
    extra = [
        F.lit(None).cast("string").alias("generation_error") if "generation_error" not in responses.columns else "generation_error",
        F.lit(False).alias("timed_out") if "timed_out" not in responses.columns else "timed_out",
    ]
    kept = [c for c in responses.columns if c not in ("generation_error", "timed_out")]
    answered = questions.drop("generated_query", *[c for c in kept if c != "qid"]).join(
        responses.select(*kept, *extra), "qid", "left"
    )
    cleaned: Column = CLEANERS[options.cleaner](F.col("content"))
    run = materialise(answered.withColumn("generated_query", F.coalesce(cleaned, F.lit(""))).withColumn("pair_id", F.col("qid")))
    usable = run.filter(F.col("generation_error").isNull() & ~F.col("timed_out"))
    gold = expand_gold(usable.select("pair_id", "query")).select("pair_id", F.lit("gold").alias("side"), "alt", "sql")
    names = usable.select("pair_id", "db_name")
    gen = usable.select(
        "pair_id", F.lit("gen").alias("side"), F.lit(None).cast("int").alias("alt"), F.col("generated_query").alias("sql")
    )
    texts = gen.unionByName(gold).join(names, "pair_id").orderBy("pair_id", "side", "alt").toLocalIterator()
    results = run_statements(spark, texts, options.decimals, options.seconds, options.workers, sessions)
    asked = usable.select(
        "pair_id", "query_category", "question", F.col("query").alias("sql_gold"), F.col("generated_query").alias("sql_gen")
    )
    scores = score_pairs(results, asked, options.order_parse).select("pair_id", "exact", "correct", "exact_alt", "error")
    scored = run.drop("exact_match", "correct", "error_msg", "error_db_exec", "error_query_gen", "timeout").join(
        scores, "pair_id", "left"
    )
    flagged = outcome_columns(
        scored, options.execution_prefix, options.mark_incorrect, options.legacy_flags
    )
    return flagged.drop("exact", "error", "generation_error", "timed_out", "pair_id")
