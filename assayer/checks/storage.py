"""Checks of reading and writing question tables, results and the run store."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.checks import check
from assayer.checks.reports import RUNS_DUCK, runs
from assayer.session import scratch, table
from assayer.sources import questions as qs
from assayer.sources import results, store

_QUESTIONS = """
SELECT concat('db', o_custkey % 4) AS db_name, o_orderpriority AS query_category, concat('Which, "exactly", is order ', o_orderkey, '?') AS question,
       concat('SELECT o_totalprice, o_custkey', chr(10), 'FROM orders WHERE o_orderkey = ', o_orderkey) AS query FROM orders
"""


def _write_questions(rows, path):
    """Question files of bounded size, as one task reads a whole file; the files of ordered rows are in order too."""
    rows.write.option("header", True).option("escape", '"').option("maxRecordsPerFile", 250_000).csv(path)


def _question_file(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    path = scratch(spark, "questions")
    _write_questions(spark.sql(_QUESTIONS), path)
    return path


@check("s1_read_questions", _QUESTIONS)
def read_questions(spark, sf_dir):
    return qs.read_questions(spark, _question_file(spark, sf_dir))


@check("s1_first_questions", _QUESTIONS + " WHERE o_orderkey < (SELECT count(*) / 2 FROM orders)")
def first_questions(spark, sf_dir):
    path = scratch(spark, "questions")
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    ordered = spark.sql(_QUESTIONS.replace("FROM orders\n", "FROM (SELECT * FROM orders ORDER BY o_orderkey)\n"))
    _write_questions(ordered, path)
    half = -(-table(spark, sf_dir, "orders").count() // 2)
    return qs.read_questions(spark, path, first=half)


@check("s1_first_of_several_files", _QUESTIONS + " WHERE o_orderkey < 12")
def first_of_several_files(spark, sf_dir):
    """Files of unequal size, the smallest first: the first rows are those of the first files."""
    path = scratch(spark, "questions")
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    ordered = spark.sql(_QUESTIONS)
    key = F.substring_index(F.col("query"), "= ", -1).cast("bigint")
    for i, (first, end) in enumerate(((0, 2), (2, 7), (7, 1_000_000_000))):
        _write_questions(ordered.where(key.between(first, end - 1)).orderBy(key), f"{path}/{i}")
    wanted = table(spark, sf_dir, "orders").where("o_orderkey < 12").count()
    return qs.read_questions(spark, f"{path}/*", first=wanted)


@check("s2_metric_columns", """
SELECT o_orderkey, 'postgres' AS db_type, '' AS generated_query, '' AS reason, '' AS error_msg, 0 AS exact_match, 0 AS correct,
       0 AS error_query_gen, 0 AS error_db_exec, 0 AS timeout, 0.0::DOUBLE AS latency_seconds, 0::BIGINT AS tokens_used FROM orders
""")
def metric_columns(spark, sf_dir):
    return qs.with_metric_columns(table(spark, sf_dir, "orders").select("o_orderkey"), "postgres")


@check("s3_optional_texts", """
SELECT o_orderkey, CASE WHEN i <> '' THEN concat(chr(10), 'Follow the instructions below to generate the query:', chr(10), replace(i, '. ', '.' || chr(10)), chr(10)) ELSE '' END AS instructions,
       concat('Adhere closely to the following correct examples as references for answering the question:', chr(10), replace(coalesce(k, ''), concat(chr(92), 'n'), chr(10))) AS k_shot_prompt,
       concat(chr(10), 'Carefully follow these instructions if and only if they are relevant to the question and the query you generate:', chr(10), coalesce(g, ''), chr(10)) AS glossary,
       coalesce(k, '') AS prev_error_msg, '' AS question_0, '' AS table_metadata_string
FROM (SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN concat('Use ', o_orderpriority, '. Keep it. short') END, '') AS i,
             CASE WHEN o_orderkey % 4 > 0 THEN concat('Q: x', chr(92), 'nA: ', o_orderkey) END AS k,
             CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS g FROM orders)
""")
def optional_texts(spark, sf_dir):
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 3 > 0, F.concat(F.lit("Use "), "o_orderpriority", F.lit(". Keep it. short"))).alias("instructions"),
        F.when(key % 4 > 0, F.concat(F.lit("Q: x\\nA: "), key.cast("string"))).alias("k_shot_prompt"),
        F.when(key % 5 > 0, F.col("o_orderstatus")).alias("glossary"),
        F.when(key % 4 > 0, F.concat(F.lit("Q: x\\nA: "), key.cast("string"))).alias("prev_error_msg"),
    )
    return qs.with_optional_texts(orders, k_shot=True).select(
        "o_orderkey", "instructions", "k_shot_prompt", "glossary", "prev_error_msg", "question_0", "table_metadata_string"
    )


@check("s4_cot_modes", f"""
SELECT o_orderkey, m AS mode, CASE WHEN m = 'instruct' THEN '{qs.COT_INSTRUCTION}' ELSE '' END AS cot_instructions, m = 'pregen' AS cot_pregen
FROM orders, (VALUES ('instruct'), ('pregen'), ('')) v(m)
""")
def cot_modes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    modes = [qs.with_cot_mode(orders, m).withColumn("mode", F.lit(m)) for m in ("instruct", "pregen", "")]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


_TAGGED = f"""
SELECT event_id, model, query_category, correct, latency_seconds, CASE WHEN model = 'm1' THEN cost_in_cents END AS cost_in_cents,
       concat('run_', model, '_api') AS file FROM ({RUNS_DUCK}) WHERE model <> 'm4'
"""


@check("s5_scan_results", _TAGGED)
def scan_folder(spark, sf_dir):
    folder = scratch(spark, "scan")
    rows = runs(spark, sf_dir).select("event_id", "model", "query_category", "correct", "latency_seconds", "cost_in_cents")
    for model in ("m0", "m1", "m2", "m3", "m4"):
        part = rows.filter(F.col("model") == model)
        part = part if model == "m1" else part.drop("cost_in_cents")
        name = f"run_{model}_api{'_old' if model == 'm4' else ''}"
        part.write.option("header", True).csv(f"{folder}/{name}.csv")
    types = {"event_id": "bigint", "correct": "int", "latency_seconds": "double", "cost_in_cents": "double"}
    return results.scan_results(spark, folder, types, include=["api"], exclude=["_old"], tag="file")


_SINK = """
SELECT db_name, query_category, question, correct::VARCHAR AS correct, printf('%.2f', latency_seconds) AS latency_seconds, event_id::VARCHAR AS event_id
"""


@check("s8_result_sink", _SINK + f"FROM ({RUNS_DUCK})")
def result_sink(spark, sf_dir):
    path = scratch(spark, "sink")
    rows = runs(spark, sf_dir).select("db_name", "query_category", "question", "correct", "latency_seconds", "event_id")
    results.write_results(rows.withColumn("prompt", F.lit("long text")), path)
    fields = "db_name STRING, query_category STRING, question STRING, correct STRING, latency_seconds STRING, event_id STRING"
    return spark.read.option("header", True).option("escape", '"').schema(fields).csv(path)


@check("s8_exact_rounding", """
SELECT o_orderkey, printf('%.2f', o_orderkey / 8.0::DOUBLE) AS eighths, printf('%.2f', -o_orderkey / 1000.0::DOUBLE) AS thousandths FROM orders
""")
def exact_rounding(spark, sf_dir):
    """Values with three decimals, of which some lie exactly between two texts and some only seem to."""
    key = F.col("o_orderkey").cast("double")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (key / 8).alias("eighths"), ((-F.col("o_orderkey")).cast("double") / 1000).alias("thousandths"))
    return results.with_two_decimals(rows)


@check("s9_record_sink", f"SELECT event_id, model, question, correct, latency_seconds FROM ({RUNS_DUCK})")
def record_sink(spark, sf_dir):
    path = scratch(spark, "records")
    results.write_records(runs(spark, sf_dir).select("event_id", "model", "question", "correct", "latency_seconds"), path)
    fields = "event_id BIGINT, model STRING, question STRING, correct INT, latency_seconds DOUBLE"
    return spark.read.schema(fields).json(path)


@check("s10_append_run", f"""
SELECT run_id, 'api_runner' AS runner_type, 'sqlite' AS db_type, question, golden_query, correct = 1 AS correct, error_db_exec = 1 AS error_db_exec, count(*) AS n
FROM (SELECT *, concat('SELECT ', user_part) AS golden_query FROM (SELECT *, split_part(question, ' ', 2) AS user_part FROM ({RUNS_DUCK}))),
     (VALUES ('first'), ('second')) v(run_id) GROUP BY ALL
""")
def append_run(spark, sf_dir):
    path, prompts = scratch(spark, "eval"), scratch(spark, "prompt")
    store.create_store(spark, path, prompts)
    rows = runs(spark, sf_dir).withColumn("query", F.concat(F.lit("SELECT "), F.split_part("question", F.lit(" "), F.lit(2))))
    for batch, run_id in enumerate(("first", "second")):
        parameters = {**store.stamp(), "run_id": run_id, "runner_type": "api_runner", "db_type": "sqlite"}
        store.append_run(rows, path, parameters, batch)
    stored = spark.read.schema(store.EVAL_FIELDS).parquet(path)
    return stored.groupBy(
        "run_id", "runner_type", "db_type", "question", "golden_query", "correct", "error_db_exec"
    ).agg(F.count(F.lit(1)).alias("n"))


@check("s11_insert_prompts", """
SELECT prompt_id, min(prompt) AS prompt, count(*) AS n FROM (
  SELECT DISTINCT concat('p', c_custkey) AS prompt_id, 'first' AS prompt FROM customer WHERE c_acctbal > 0
  UNION ALL SELECT DISTINCT concat('p', o_custkey), 'second' FROM orders
  WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) GROUP BY prompt_id
""")
def insert_prompts(spark, sf_dir):
    evals, path = scratch(spark, "eval"), scratch(spark, "prompt")
    store.create_store(spark, evals, path)
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    first = rich.select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("prompt_id"), F.lit("first").alias("prompt"))
    second = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("prompt_id"), F.lit("second").alias("prompt")
    )
    store.insert_prompts(spark, first, path, 0)
    store.insert_prompts(spark, second, path, 1)
    stored = spark.read.schema(store.PROMPT_FIELDS).parquet(path)
    return stored.groupBy("prompt_id").agg(F.min("prompt").alias("prompt"), F.count(F.lit(1)).alias("n"))
