"""Checks of run metrics; the events stand in for evaluated rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.checks import check
from assayer.operators import metrics
from assayer.operators.capture import number_rows
from assayer.session import table
from assayer.sources.store import nested_rows, stamp, store_rows

# Evaluated rows out of events; the category is NULL for some of them.
RUNS_SQL = """
SELECT event_id, ts, CASE WHEN event_id % 11 > 0 THEN event_type END AS query_category, concat('m', user_id % 5) AS model,
       CASE WHEN user_id % 7 > 0 THEN concat('db', user_id % 4) END AS db_name, concat('question ', user_id) AS question,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS error_db_exec,
       CASE WHEN {k} >= 50 THEN 1 ELSE 0 END AS correct, value AS latency_seconds,
       CASE WHEN event_id % 13 > 0 THEN value / 100 END AS cost_in_cents,
       CASE WHEN event_id % 6 = 5 THEN 'other' WHEN event_id % 6 = 4 THEN 'idk' WHEN event_id % 6 = 3 THEN 'advanced'
            WHEN event_id % 6 = 2 THEN 'v1' ELSE 'basic' END AS eval_type,
       CAST(event_id % 3 * 100 AS INT) AS checkpoint, CASE WHEN event_id % 2 = 0 THEN 'cot' ELSE 'no_cot' END AS cot_inference
FROM events
"""
RUNS_DUCK = RUNS_SQL.format(k="CAST(json_extract(props, '$.k') AS INT)")
_WITH = f"WITH r AS ({RUNS_DUCK}) "


def runs(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(RUNS_SQL.format(k="CAST(get_json_object(props, '$.k') AS INT)"))


@check("m1_category_means", _WITH + """
SELECT query_category, round(avg(correct), 9) AS mean_correct, round(avg(error_db_exec), 9) AS mean_error_db_exec
FROM r WHERE query_category IS NOT NULL GROUP BY 1
""")
def category_means(spark, sf_dir):
    report = metrics.category_report(runs(spark, sf_dir))
    return report.select(
        "query_category", *[F.round(c, 9).alias(c) for c in ("mean_correct", "mean_error_db_exec")]
    )


@check("m2_category_counts", _WITH + """
SELECT query_category, count(db_name) AS num_rows, round(avg(correct), 9) AS mean_correct, round(avg(error_db_exec), 9) AS mean_error_db_exec,
       max(latency_seconds) AS slowest FROM r WHERE query_category IS NOT NULL GROUP BY 1
""")
def category_counts(spark, sf_dir):
    report = metrics.category_report(
        runs(spark, sf_dir), with_count=True, metrics=[F.max("latency_seconds").alias("slowest")]
    )
    return report.select(
        "query_category", "num_rows", "slowest",
        *[F.round(c, 9).alias(c) for c in ("mean_correct", "mean_error_db_exec")],
    )


@check("m3_overall_rate", _WITH + "SELECT sum(correct) / count(*) AS rate FROM r")
def overall_rate(spark, sf_dir):
    return metrics.overall_rate(runs(spark, sf_dir))


@check("m4_running_accuracy", _WITH + """
SELECT model, event_id, sum(correct) OVER w::BIGINT AS correct_so_far, count(*) OVER w AS tried_so_far,
       CAST(printf('%.2f', 100 * sum(correct) OVER w / count(*) OVER w) AS DOUBLE) AS percent
FROM r WINDOW w AS (PARTITION BY model ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""".replace("sum(correct) OVER w::BIGINT", "CAST(sum(correct) OVER w AS BIGINT)"))
def running_accuracy(spark, sf_dir):
    running = metrics.running_accuracy(runs(spark, sf_dir), ["model"], ["ts", "event_id"])
    return running.select("model", "event_id", "correct_so_far", "tried_so_far", "percent")


@check("m5_total_cost", _WITH + "SELECT round(sum(cost_in_cents), 4) AS total_cents FROM r")
def total_cost(spark, sf_dir):
    return metrics.total_cost(runs(spark, sf_dir)).select(F.round("total_cents", 4).alias("total_cents"))


@check("m6_category_order", _WITH + """
, c AS (SELECT query_category, avg(correct) AS rate FROM r WHERE query_category IS NOT NULL GROUP BY 1)
SELECT query_category, round(rate, 9) AS rate, row_number() OVER (ORDER BY rate DESC, query_category) AS best,
       row_number() OVER (ORDER BY rate, query_category) AS worst FROM c
""")
def category_order(spark, sf_dir):
    rows = runs(spark, sf_dir)
    best = number_rows(metrics.category_rates(rows).select("query_category", "correct"), into="best")
    keys = metrics.category_map(rows).select(F.posexplode("category_corr").alias("worst", "query_category", "value"))
    return best.join(keys, "query_category").select(
        "query_category",
        F.round("value", 9).alias("rate"),
        (F.col("best") + 1).alias("best"),
        (F.col("worst") + 1).cast("bigint").alias("worst"),
    )


@check("m7_model_report", _WITH + """
SELECT model, CASE WHEN eval_type <> 'other' THEN eval_type END AS eval_type, checkpoint, cot_inference, 'correct' AS metric,
       round(avg(correct), 9) AS correct_pct,
       CASE eval_type WHEN 'basic' THEN 1 WHEN 'v1' THEN 2 WHEN 'advanced' THEN 3 WHEN 'idk' THEN 4 END::BIGINT AS eval_rank
FROM r GROUP BY model, r.eval_type, checkpoint, cot_inference
""")
def model_report(spark, sf_dir):
    report = metrics.model_report(runs(spark, sf_dir))
    return report.withColumn("correct_pct", F.round("correct_pct", 9)).withColumn(
        "eval_rank", F.col("eval_rank").cast("bigint")
    )


FILES_SQL = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       concat('model_', CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE 'y' END, '_c', (o_orderkey % 4 + 1) * 100, '_postgres_api',
              CASE WHEN o_custkey % 2 = 0 THEN '_cot' ELSE '' END, '_',
              CASE o_orderkey % 5 WHEN 0 THEN 'basic' WHEN 1 THEN 'v1' WHEN 2 THEN 'advanced' WHEN 3 THEN 'idk' ELSE 'extra' END) AS file_name
FROM orders
"""
_SUFFIX = """
CASE o_orderkey % 5 WHEN 0 THEN 'basic' WHEN 1 THEN 'v1' WHEN 2 THEN 'advanced' WHEN 3 THEN 'idk' ELSE 'extra' END
"""


@check("m8_file_tags", f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN {_SUFFIX} END AS benchmark, CAST((o_orderkey % 4 + 1) * 100 AS INT) AS checkpoint,
       CASE WHEN o_custkey % 2 = 0 THEN 'cot' ELSE 'no_cot' END AS cot, {_SUFFIX} AS tail,
       concat('model_', CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE 'y' END, '_c', (o_orderkey % 4 + 1) * 100, '_postgres_api',
              CASE WHEN o_custkey % 2 = 0 THEN '_cot' ELSE '' END) AS stem,
       concat('c', (o_orderkey % 4 + 1) * 100) AS model_checkpoint, {_SUFFIX} AS model_eval, CASE WHEN o_custkey % 2 = 0 THEN 'cot' ELSE 'no_cot' END AS model_mode
FROM orders
""")
def file_tags(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    named = spark.sql(FILES_SQL)
    name = F.col("file_name")
    by_model = metrics.model_file_tags(F.concat(name, F.lit(".csv")), F.substring(name, 1, len("model_x")))
    return named.select(
        "o_orderkey",
        *[c.alias(n) for n, c in metrics.file_tags(name).items()],
        *[c.alias(n) for n, c in metrics.split_tail(name).items()],
        by_model["checkpoint"].alias("model_checkpoint"),
        by_model["eval_type"].alias("model_eval"),
        by_model["cot_inference"].alias("model_mode"),
    )


@check("m9_checkpoint_metrics", f"""
WITH f AS (SELECT o_orderkey % 4 * 100 + 100 AS checkpoint, {_SUFFIX} AS benchmark, o_custkey % 2 = 0 AS cot, o_orderkey % 2 AS m,
                  avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS correct
           FROM orders GROUP BY ALL),
g AS (SELECT checkpoint, benchmark, cot, count(*) AS n, min(correct) AS correct FROM f GROUP BY ALL)
SELECT checkpoint::INT AS checkpoint, checkpoint::INT + 1000 AS step,
       round(max(correct) FILTER (n = 1 AND benchmark = 'basic' AND NOT cot), 9) AS basic, round(max(correct) FILTER (n = 1 AND benchmark = 'basic' AND cot), 9) AS basic_cot,
       round(max(correct) FILTER (n = 1 AND benchmark = 'v1' AND NOT cot), 9) AS v1, round(max(correct) FILTER (n = 1 AND benchmark = 'advanced' AND cot), 9) AS advanced_cot,
       round(max(correct) FILTER (n = 1 AND benchmark = 'idk' AND NOT cot), 9) AS idk
FROM g GROUP BY 1, 2
""")
def checkpoint_metrics(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    rates = spark.sql(FILES_SQL).groupBy("file_name").agg(
        F.avg(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("correct")
    )
    wide = metrics.checkpoint_metrics(rates.withColumns(metrics.file_tags(F.col("file_name"))), offset=1000)
    shown = {"vllm/basic": "basic", "vllm/basic_cot": "basic_cot", "vllm/v1": "v1", "vllm/advanced_cot": "advanced_cot", "vllm/idk": "idk"}
    return wide.select("checkpoint", "step", *[F.round(F.col(f"`{c}`"), 9).alias(n) for c, n in shown.items()])


@check("m10_report_order", _WITH + """
SELECT event_id, row_number() OVER (ORDER BY db_name NULLS FIRST, query_category NULLS FIRST, question, event_id) - 1 AS place
FROM (SELECT event_id, db_name, query_category, concat(question, '/', printf('%08d', event_id)) AS question FROM r)
""")
def report_order(spark, sf_dir):
    rows = runs(spark, sf_dir).withColumn(
        "question", F.concat("question", F.lit("/"), F.format_string("%08d", F.col("event_id")))
    )
    ordered = metrics.report_order(rows.select("event_id", "db_name", "query_category", "question"))
    return number_rows(ordered, into="place").select("event_id", "place")


@check("m11_run_stamp", _WITH + """
SELECT 32::BIGINT AS id_length, true AS id_is_hex, true AS just_now, count(*) AS n_rows FROM r
""")
def run_stamp(spark, sf_dir):
    rows = runs(spark, sf_dir).select("question", "query_category", "correct", "error_db_exec", "latency_seconds")
    stamped = store_rows(rows, stamp()).groupBy("run_id", "created_at").agg(F.count(F.lit(1)).alias("n_rows"))
    age = F.abs(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("created_at"))
    return stamped.select(
        F.length("run_id").cast("bigint").alias("id_length"), F.col("run_id").rlike("^[0-9a-f]{32}$").alias("id_is_hex"), (age < 3600).alias("just_now"), "n_rows"
    )


@check("s10_stored_rows", _WITH + """
SELECT event_id, 'run-1' AS run_id, model, 4 AS num_beams, correct = 1 AS correct, error_db_exec = 1 AS error_db_exec, latency_seconds FROM r
""")
def stored_rows(spark, sf_dir):
    rows = runs(spark, sf_dir)
    nested = nested_rows(rows.select("event_id", "model", "correct", "error_db_exec", "latency_seconds"), {"run_id": "run-1", "num_beams": 4})
    return nested.select(
        "event_id", "run_params.run_id", "model", "run_params.num_beams", F.col("correct").cast("boolean").alias("correct"),
        F.col("error_db_exec").cast("boolean").alias("error_db_exec"), "latency_seconds",
    )
