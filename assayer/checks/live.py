"""Checks of live runs: the events arrive as several files."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.checks import check
from assayer.checks.matching import PAIR_ORACLE, pair_rows, plain_questions
from assayer.checks.reports import RUNS_DUCK, runs
from assayer.session import materialise, scratch
from assayer.sources import store
from assayer.streaming import live, scoring

_FIELDS = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, query_category STRING, model STRING, db_name STRING, question STRING, "
    "error_db_exec INT, correct INT, latency_seconds DOUBLE"
)


def _arrived(spark, sf_dir, fmt="parquet"):
    """A fresh folder with the evaluated rows in four files."""
    folder = scratch(spark, "arrived")
    columns = [f.strip().split(" ")[0] for f in _FIELDS.split(",")]
    # Questions of two lines: generated texts nearly always break lines.
    rows = runs(spark, sf_dir).select(*columns).withColumn("question", F.concat("question", F.lit("\n"), "model")).repartition(4, "event_id")
    rows.write.options(header=True, escape='"').format(fmt).save(folder)
    return folder


@check("st1_watch_results", f"SELECT event_id, query_category, question || chr(10) || model AS question, correct, latency_seconds FROM ({RUNS_DUCK})")
def watch_results(spark, sf_dir):
    folder, done = _arrived(spark, sf_dir, "csv"), scratch(spark, "collected")
    rows = live.watch_results(
        spark, folder, _FIELDS.replace("TIMESTAMP_NTZ", "STRING"), "csv", archive=scratch(spark, "archive")
    )
    live.collect_results(rows, done, scratch(spark, "checkpoint")).awaitTermination()
    stored = spark.read.schema(_FIELDS.replace("TIMESTAMP_NTZ", "STRING")).parquet(done)
    return stored.select("event_id", "query_category", "question", "correct", "latency_seconds")


@check("st2_live_accuracy", f"""
SELECT query_category, count(*) AS tried, CAST(sum(correct) AS BIGINT) AS "right", round(avg(correct), 9) AS mean_correct FROM ({RUNS_DUCK}) GROUP BY 1
""")
def live_accuracy(spark, sf_dir):
    rows = live.watch_results(spark, _arrived(spark, sf_dir), _FIELDS, "parquet", files_per_batch=2)
    path = scratch(spark, "report")
    live.publish(live.live_accuracy(rows), path, scratch(spark, "checkpoint")).awaitTermination()
    batches = spark.read.schema(
        "query_category STRING, tried BIGINT, `right` BIGINT, mean_correct DOUBLE, batch BIGINT"
    ).parquet(path)
    last = batches.agg(F.max("batch").alias("batch"))
    final = batches.join(F.broadcast(last), "batch")
    return final.select("query_category", "tried", "right", F.round("mean_correct", 9).alias("mean_correct"))


@check("st2_hourly_accuracy", f"""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS tried, round(avg(correct), 9) AS mean_correct FROM ({RUNS_DUCK}) GROUP BY 1
""")
def hourly_accuracy(spark, sf_dir):
    """One file a batch, each file over the whole time, so nearly all rows are days late; folded half-way."""
    folder, path, checkpoint = scratch(spark, "late"), scratch(spark, "report"), scratch(spark, "checkpoint")
    rows = runs(spark, sf_dir).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "correct")
    stamped = rows.withColumn("ts", F.to_timestamp("ts", "yyyy-MM-dd HH:mm:ss"))
    for part in range(2):
        stamped.filter(F.col("event_id") % 2 == part).repartition(3, "event_id").write.mode("append").parquet(folder)
        arriving = live.watch_results(spark, folder, "event_id BIGINT, ts TIMESTAMP, correct INT", "parquet", files_per_batch=1)
        live.publish_hourly(arriving, "ts", path, checkpoint).awaitTermination()
        live.fold_hourly(spark, path)
    report = live.hourly_accuracy(spark, path)
    return report.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "tried", F.round("mean_correct", 9).alias("mean_correct"))


@check("st1_scored_runs", PAIR_ORACLE + "SELECT pair_id, exact, exact OR subset AS correct, true AS scored_once FROM s")
def scored_runs(spark, sf_dir):
    """Both sides of all pairs arrive over several batches, some parts twice, and the stream is started twice."""
    folder, path, checkpoint = scratch(spark, "delivered"), scratch(spark, "scored"), scratch(spark, "checkpoint")
    rows = materialise(pair_rows(spark, sf_dir))
    asked = materialise(plain_questions(spark, rows))
    delivered = materialise(scoring.with_markers(rows, rows_per_part=16))
    for side in ("gold", "gen"):
        scoring.deliver(delivered.filter(F.col("side") == side), folder, 3)
        scoring.score_arrivals(spark, folder, asked, path, checkpoint, files_per_batch=2).awaitTermination()
    scoring.deliver(delivered.filter("pair_id % 3 = 0 AND side = 'gold'"), folder, 1)
    scoring.score_arrivals(spark, folder, asked, path, checkpoint, files_per_batch=2).awaitTermination()
    scores = scoring.arrived_scores(spark, path)
    once = scores.groupBy("pair_id").agg((F.count(F.lit(1)) == 1).alias("scored_once"))
    return scores.join(once, "pair_id").select("pair_id", "exact", "correct", "scored_once")


@check("st3_append_to_store", f"""
SELECT concat('p-', model) AS prompt_id, 1::BIGINT AS n_prompts, count(*) AS n_rows, CAST(sum(correct) AS BIGINT) AS n_correct FROM ({RUNS_DUCK}) GROUP BY 1
""")
def append_to_store(spark, sf_dir):
    rows = live.watch_results(spark, _arrived(spark, sf_dir), _FIELDS, "parquet")
    tagged = rows.withColumns(
        {"prompt_id": F.concat(F.lit("p-"), "model"), "prompt": F.concat(F.lit("prompt of "), "model"), "query": F.lit("SELECT 1")}
    )
    evals, prompts = scratch(spark, "eval"), scratch(spark, "prompt")
    store.create_store(spark, evals, prompts)
    live.append_to_store(tagged, evals, prompts, scratch(spark, "checkpoint"), {"run_id": "live"}).awaitTermination()
    stored = spark.read.schema(store.EVAL_FIELDS).parquet(evals)
    known = spark.read.schema(store.PROMPT_FIELDS).parquet(prompts)
    counted = known.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("n_prompts"))
    rows_of = stored.groupBy("prompt_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("correct").cast("bigint")).alias("n_correct")
    )
    return counted.join(rows_of, "prompt_id")


@check("st3_two_streams_and_a_run", f"""
SELECT run_id, count(*) AS n_rows, (SELECT count(DISTINCT model) FROM ({RUNS_DUCK})) AS n_prompts
FROM ({RUNS_DUCK}), (VALUES ('one/a'), ('two'), ('batch')) v(run_id) GROUP BY run_id
""")
def two_streams_and_a_run(spark, sf_dir):
    """Streams that begin anew and a batch run write into one store, and nothing is lost."""
    evals, prompts = scratch(spark, "eval"), scratch(spark, "prompt")
    store.create_store(spark, evals, prompts)
    extra = {"prompt_id": F.concat(F.lit("p-"), "model"), "prompt": F.concat(F.lit("prompt of "), "model"), "query": F.lit("SELECT 1")}
    store.append_run(runs(spark, sf_dir).withColumns(extra), evals, {"run_id": "batch"})
    for run in ("one/a", "two"):
        rows = live.watch_results(spark, _arrived(spark, sf_dir), _FIELDS, "parquet", files_per_batch=2).withColumns(extra)
        live.append_to_store(rows, evals, prompts, scratch(spark, "checkpoint"), {"run_id": run}).awaitTermination()
    known = spark.read.schema(store.PROMPT_FIELDS).parquet(prompts).agg(F.count("prompt_id").alias("n_prompts"))
    stored = spark.read.schema(store.EVAL_FIELDS).parquet(evals).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return stored.crossJoin(F.broadcast(known))
