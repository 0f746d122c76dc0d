"""Checks of running and validating statements on the given tables."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from assayer.checks import check
from assayer.plans import execute
from assayer.plans.benchmark import Benchmark, run_benchmark
from assayer.plans.evaluate import RunOptions, evaluate_run
from assayer.session import scratch, table
from assayer.sources import store
from assayer.sources.database import load_database, run_query, schema_session
from assayer.sources.questions import QUESTION_FIELDS

_SEGMENTS = """
SELECT c.c_mktsegment AS segment, count(o.o_orderkey) AS n_orders, max(o.o_totalprice) AS top_price
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment
"""


@check("s6_run_on_database", _SEGMENTS.replace("max(o.o_totalprice)", "round_even(max(o.o_totalprice) * 10, 0) / 10"))
def run_on_database(spark, sf_dir):
    load_database(spark, sf_dir, ["customer", "orders"])
    return run_query(spark, _SEGMENTS + ";", decimals=1)


def _schema_text(spark, sf_dir, names):
    """DDL text of given tables, built from their own columns."""
    lines = []
    for name in names:
        fields = table(spark, sf_dir, name).schema.fields
        columns = "\n".join(
            f"  {f.name} {f.dataType.simpleString()}{',' if f is not fields[-1] else ''} --a column of {name}, as read"
            for f in fields
        )
        lines.append(f"CREATE TABLE shop.{name} (\n{columns}\n);")
    return "\n".join(lines)


@check("s7_empty_database", """
SELECT c_custkey, c_custkey % 3 > 0 AS valid, CASE WHEN c_custkey % 3 = 0 THEN 'UNRESOLVED_COLUMN.WITH_SUGGESTION' ELSE '' END AS err FROM customer
""")
def empty_tables(spark, sf_dir):
    """A statement about every customer, checked in a database that is only a schema."""
    ddl = _schema_text(spark, sf_dir, ["customer", "orders"])
    asked = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id",
        "concat('SELECT sum(', CASE c_custkey % 3 WHEN 0 THEN 'o_price' ELSE 'o_totalprice' END, ') FROM customer JOIN orders ON c_custkey = o_custkey',"
        " ' WHERE c_name = \\'', c_name, '\\' AND c_mktsegment <> \\'', c_mktsegment, '\\'', CASE c_custkey % 3 WHEN 2 THEN ' GROUP BY c_nationkey' ELSE '' END) AS sql",
    )
    return execute.validate_sql(spark, asked, ddl=ddl).withColumnRenamed("id", "c_custkey")


@check("x1_time_limit", """
SELECT count(*) AS n_rows, true AS cancelled FROM lineitem
""")
def time_limit(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")

    def slow(batches):
        for batch in batches:
            time.sleep(30)
            yield batch

    try:
        execute.run_limited(spark, lambda: items.mapInPandas(slow, items.schema).count(), seconds=1.0)
        cancelled = False
    except execute.StatementTimeout:
        cancelled = True
    # The session is still usable and the same statement passes without a delay.
    n = execute.run_limited(spark, items.count, seconds=120.0)
    return spark.createDataFrame([(n, cancelled)], "n_rows bigint, cancelled boolean")


_STATEMENTS = [
    "SELECT c_custkey FROM customer WHERE c_acctbal > 0",
    "SELECT o_orderkey FROM orders WHERE o_totalprice < 0",
    "SELECT nothing_like_this FROM orders",
    "SELECT * FROM no_such_table",
    "SELEC o_orderkey FROM orders",
    "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
]


def _numbered(spark):
    return spark.createDataFrame(list(enumerate(_STATEMENTS)), "id bigint, sql string")


@check("x2_validity", f"""
SELECT 0::BIGINT AS id, count(*) > 0 AS valid, CASE WHEN count(*) > 0 THEN '' ELSE '{execute.EMPTY_RESULT}' END AS err FROM customer WHERE c_acctbal > 0
UNION ALL SELECT 1, count(*) > 0, CASE WHEN count(*) > 0 THEN '' ELSE '{execute.EMPTY_RESULT}' END FROM orders WHERE o_totalprice < 0
UNION ALL SELECT 2, false, 'UNRESOLVED_COLUMN.WITH_SUGGESTION'
UNION ALL SELECT 3, false, 'TABLE_OR_VIEW_NOT_FOUND'
UNION ALL SELECT 4, false, 'PARSE_SYNTAX_ERROR'
UNION ALL SELECT 5, count(*) > 0, CASE WHEN count(*) > 0 THEN '' ELSE '{execute.EMPTY_RESULT}' END FROM orders JOIN lineitem ON o_orderkey = l_orderkey
""")
def validity(spark, sf_dir):
    load_database(spark, sf_dir, ["customer", "orders", "lineitem"])
    return execute.validate_sql(spark, _numbered(spark))


@check("x3_validity_on_schema", """
SELECT o_orderkey AS id, o_orderkey % 5 < 2 AS valid,
       CASE o_orderkey % 5 WHEN 2 THEN 'UNRESOLVED_COLUMN.WITH_SUGGESTION' WHEN 3 THEN 'TABLE_OR_VIEW_NOT_FOUND'
                           WHEN 4 THEN 'PARSE_SYNTAX_ERROR' ELSE '' END AS err
FROM orders
""")
def validity_on_schema(spark, sf_dir):
    """A statement of its own for every order."""
    ddl = _schema_text(spark, sf_dir, ["customer", "orders", "lineitem"])
    asked = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id",
        "concat(CASE o_orderkey % 5 WHEN 0 THEN 'SELECT o_orderdate FROM orders' WHEN 1 THEN 'SELECT count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey'"
        " WHEN 2 THEN 'SELECT nothing_like_this FROM orders' WHEN 3 THEN 'SELECT * FROM no_such_table' ELSE 'SELEC o_orderkey FROM orders' END,"
        " ' WHERE o_orderkey = ', o_orderkey, ' AND o_orderpriority = \\'', o_orderpriority, '\\'') AS sql",
    )
    return execute.validate_sql(spark, asked, ddl=ddl)


@check("x4_pool_in_order", """
SELECT 0::BIGINT AS place, 'lineitem' AS name, count(*) AS n FROM lineitem UNION ALL SELECT 1, 'orders', count(*) FROM orders
UNION ALL SELECT 2, 'nation', count(*) FROM nation UNION ALL SELECT 3, 'events', count(*) FROM events
UNION ALL SELECT 4, 'customer', count(*) FROM customer UNION ALL SELECT 5, 'documents', count(*) FROM documents
""")
def pool_in_order(spark, sf_dir):
    names = ["lineitem", "orders", "nation", "events", "customer", "documents"]
    counts = execute.in_pool(spark, names, lambda n: table(spark, sf_dir, n).count(), workers=3)
    return spark.createDataFrame(list(zip(range(6), names, counts)), "place bigint, name string, n bigint")


@check("x5_generator", """
SELECT conv_id, turn, concat('SELECT ', length(text), ';') AS content FROM conversations
""")
def generator(spark, sf_dir):
    prompts = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")

    def answer(batches):
        for batch in batches:
            batch["content"] = "SELECT " + batch["text"].str.len().astype(str) + ";"
            yield batch[["conv_id", "turn", "content"]]

    return execute.generate(prompts, answer, "conv_id bigint, turn bigint, content string")


@check("x5_recorded_responses", """
SELECT q.o_orderkey AS qid, q.o_orderpriority AS model, r.l_linenumber IS NOT NULL AS answered, r.l_linenumber::BIGINT AS tokens
FROM orders q LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey) r ON q.o_orderkey = r.l_orderkey
""")
def recorded(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"), F.col("o_orderpriority").alias("model"))
    answers = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("qid"))
        .agg(F.max("l_linenumber").cast("bigint").alias("tokens"))
    )
    joined = execute.recorded_responses(asked, answers.join(asked, "qid"))
    return joined.select("qid", "model", F.col("tokens").isNotNull().alias("answered"), "tokens")


_RUN = [
    # qid, category, question, gold, answer, generation error
    (0, "basic_left_join", "Which orders have no line items?",
     "SELECT o.o_orderkey FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_orderkey IS NULL",
     "```sql\nSELECT o_orderkey AS k, o_custkey FROM orders LEFT ANTI JOIN lineitem ON o_orderkey = l_orderkey;\n```", None),
    (1, "basic_group_order_limit", "How many orders per status?",
     "SELECT {o_orderstatus, o_orderpriority}, COUNT(*) AS n FROM orders GROUP BY {};",
     "Sure: ```sql SELECT o_orderpriority, COUNT(o_orderkey) FROM orders GROUP BY 1```", None),
    (2, "basic_join_distinct", "Which segments buy?",
     "SELECT DISTINCT c_mktsegment FROM customer JOIN orders ON c_custkey = o_custkey",
     "SELECT DISTINCT c_mktsegment FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment <> 'BUILDING'", None),
    (3, "basic_join_distinct", "Which priorities?", "SELECT DISTINCT o_orderpriority FROM orders",
     "SELECT DISTINCT priority FROM orders", None),
    (4, "basic_join_distinct", "Which return flags?", "SELECT DISTINCT l_returnflag FROM lineitem", None, "refused"),
    (5, "order_by", "Sort the statuses by number of orders.",
     "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus ORDER BY n DESC, o_orderstatus",
     "SELECT o_orderstatus AS s, COUNT(*) AS n FROM orders GROUP BY o_orderstatus ORDER BY n DESC, s", None),
]
_ORACLE_RUN = """
WITH g0 AS (SELECT o.o_orderkey FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_orderkey IS NULL),
n0 AS (SELECT o_orderkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey),
g1 AS (SELECT o_orderpriority, count(*) FROM orders GROUP BY 1),
g2 AS (SELECT DISTINCT c_mktsegment FROM customer JOIN orders ON c_custkey = o_custkey),
n2 AS (SELECT * FROM g2 WHERE c_mktsegment <> 'BUILDING')
SELECT 0::BIGINT AS qid, false AS exact, (SELECT count(*) FROM (FROM g0 EXCEPT FROM n0)) = 0 AND (SELECT count(*) FROM g0) = (SELECT count(*) FROM n0) AS correct, '' AS error_class
UNION ALL SELECT 1, count(*) > 0, count(*) > 0, '' FROM g1
UNION ALL SELECT 2, false, (SELECT count(*) FROM (FROM g2 EXCEPT FROM n2)) = 0, 'incorrect'
UNION ALL SELECT 3, false, false, 'execution'
UNION ALL SELECT 4, false, false, 'generation'
UNION ALL SELECT 5, true, true, ''
"""


@check("c20_evaluate_run", _ORACLE_RUN)
def whole_run(spark, sf_dir):
    questions = spark.createDataFrame(
        [(q, "shop", c, t, g) for q, c, t, g, _, _ in _RUN],
        "qid bigint, db_name string, query_category string, question string, query string",
    )
    responses = spark.createDataFrame(
        [(r[0], r[4], r[5]) for r in _RUN], "qid bigint, content string, generation_error string"
    )
    run = evaluate_run(spark, questions, responses, sf_dir, RunOptions(seconds=60.0))
    return run.select(
        "qid", (F.col("exact_match") == 1).alias("exact"), (F.col("correct") == 1).alias("correct"), "error_class"
    )


@check("c20_two_databases", """
WITH few AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0)
SELECT 0::BIGINT AS qid, (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 2 = 1) IS NULL AS exact
UNION ALL SELECT 1, (SELECT max(o_orderkey) FROM few WHERE o_orderkey % 2 = 1) IS NULL
UNION ALL SELECT 2, (SELECT count(*) FROM (SELECT o_orderkey FROM orders WHERE false)) = 0
UNION ALL SELECT 3, false
""")
def two_databases(spark, sf_dir):
    """Two databases with a table of the same name, one that only exists as a DDL text, one that isn't there."""
    few = scratch(spark, "few")
    table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").write.parquet(f"{few}/orders.parquet")
    odd = "SELECT max(o_orderkey) AS m FROM orders WHERE o_orderkey % 2 = 1"
    asked = [(0, "all", odd), (1, "few", odd), (2, "planned", "SELECT o_orderkey FROM orders"), (3, "missing", odd)]
    questions = spark.createDataFrame(
        [(q, d, "basic", "Which is the largest odd one?", s) for q, d, s in asked],
        "qid bigint, db_name string, query_category string, question string, query string",
    )
    answers = ["SELECT CAST(NULL AS BIGINT) AS m", "SELECT CAST(NULL AS BIGINT) AS m", "SELECT o_orderkey FROM orders WHERE o_orderkey > 0", odd]
    responses = spark.createDataFrame([(i, f"```sql\n{a}\n```") for i, a in enumerate(answers)], "qid bigint, content string")
    databases = {"all": sf_dir, "few": few, "planned": _schema_text(spark, sf_dir, ["orders"])}
    run = evaluate_run(spark, questions, responses, databases, RunOptions(seconds=60.0))
    return run.select("qid", (F.col("exact_match") == 1).alias("exact"))


@check("c20_benchmark", f"""
WITH r AS ({_ORACLE_RUN}), c(qid, query_category) AS (VALUES {", ".join(f"({r[0]}, '{r[1]}')" for r in _RUN)})
SELECT query_category, count(*) AS num_rows, round(avg(correct::INT), 9) AS mean_correct, count(*) AS n_written, count(*) AS n_stored, count(*) AS n_prompts
FROM r JOIN c USING (qid) GROUP BY query_category
""")
def whole_benchmark(spark, sf_dir):
    """From the question file to the report, the result file, the stored rows and the stored prompts."""
    path, out = scratch(spark, "questions"), {n: scratch(spark, n) for n in ("result", "eval", "prompt")}
    questions = spark.createDataFrame([("shop", c, t, g) for _, c, t, g, _, _ in _RUN], QUESTION_FIELDS)
    questions.coalesce(1).write.option("header", True).option("escape", '"').csv(path)
    answers = spark.createDataFrame([(r[0], r[4], r[5]) for r in _RUN], "qid bigint, content string, generation_error string")
    store.create_store(spark, out["eval"], out["prompt"])
    plan = Benchmark(
        path, {"shop": sf_dir}, answers, out["result"], out["eval"], out["prompt"], {"run_id": "one"}, options=RunOptions(seconds=60.0)
    )
    report = run_benchmark(spark, plan).select("query_category", "num_rows", F.round("mean_correct", 9).alias("mean_correct"))
    written = spark.read.options(header=True, multiLine=True, escape='"').csv(out["result"])
    stored = spark.read.schema(store.EVAL_FIELDS).parquet(out["eval"])
    prompts = spark.read.schema(store.PROMPT_FIELDS).parquet(out["prompt"])
    asked = questions.select(F.concat("question", F.lit("\n")).alias("prompt"), "query_category").join(prompts, "prompt")
    for name, rows in (("n_written", written), ("n_stored", stored), ("n_prompts", asked)):
        report = report.join(rows.groupBy("query_category").agg(F.count(F.lit(1)).alias(name)), "query_category")
    return report


def orders_without_items_scores(spark, sf_dir):
    """The flagship: a generated statement with one more column is correct but not exact."""
    questions = spark.createDataFrame(
        [(q, "shop", c, t, g) for q, c, t, g, _, _ in _RUN[:1]],
        "qid bigint, db_name string, query_category string, question string, query string",
    )
    responses = spark.createDataFrame([(r[0], r[4]) for r in _RUN[:1]], "qid bigint, content string")
    return evaluate_run(spark, questions, responses, sf_dir, RunOptions(seconds=None))
