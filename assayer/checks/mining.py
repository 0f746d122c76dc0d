"""Checks of error mining on evaluated rows made from orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.checks import check
from assayer.checks.reports import RUNS_DUCK
from assayer.checks.reports import runs as event_runs
from assayer.operators import errors
from assayer.session import table

RUNS_SQL = """
SELECT o_orderkey, o_orderstatus AS db_name, concat('question of ', o_custkey) AS question,
       CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS correct, CASE WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0 END AS error_db_exec,
       concat(CASE WHEN o_orderkey % 2 = 0 THEN 'QUERY EXECUTION ERROR:' ELSE '' END, ' column ', o_orderpriority, ' missing',
              CASE WHEN o_orderkey % 4 > 0 THEN concat(chr(10), chr(10), 'LINE 1') ELSE '' END) AS error_msg,
       CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS instructions,
       concat(CASE WHEN o_orderkey % 4 = 0 THEN 'WITH t AS (SELECT 1) ' ELSE '' END, 'SELECT ',
              CASE WHEN o_orderkey % 3 = 0 THEN 'DISTINCT ' ELSE '' END, 'c.c_name, date_trunc(~month~, o.o_orderdate)',
              CASE WHEN o_orderkey % 7 = 0 THEN ', CASE WHEN o.x > 1 THEN 1 END, rank() over (order by o.y)' ELSE '' END,
              ' FROM customer c JOIN orders AS o ON c.c_custkey = o.o_custkey',
              CASE WHEN o_orderkey % 2 = 0 THEN concat(' WHERE c.c_name ilike ~', o_orderpriority, '~') ELSE ' GROUP BY 1 HAVING count(*) > 1' END,
              CASE WHEN o_orderkey % 5 = 0 THEN ' ORDER BY 1 LIMIT 5' ELSE '' END) AS query
FROM orders
"""
_WITH = f"WITH r AS ({RUNS_SQL}) "


def runs(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(RUNS_SQL)


_SHORT = "replace(split_part(error_msg, chr(10) || chr(10), 1), 'QUERY EXECUTION ERROR:', '')"


@check("e1_short_error", _WITH + f"SELECT o_orderkey, {_SHORT} AS short FROM r")
def short_error(spark, sf_dir):
    return runs(spark, sf_dir).select("o_orderkey", errors.short_error(F.col("error_msg")).alias("short"))


@check("e2_execution_errors", _WITH + f"SELECT o_orderkey, db_name, question, {_SHORT} AS error_msg_short FROM r WHERE error_db_exec = 1")
def execution_errors(spark, sf_dir):
    return errors.execution_errors(runs(spark, sf_dir), ["o_orderkey", "db_name", "question", "error_msg_short"])


@check("e3_recurring_rows", _WITH + """
SELECT o_orderkey, db_name, question FROM (SELECT *, count(*) OVER (PARTITION BY db_name, question) AS n FROM r WHERE error_db_exec = 1) WHERE n > 1
""")
def recurring_rows(spark, sf_dir):
    failed = runs(spark, sf_dir).filter("error_db_exec = 1").select("o_orderkey", "db_name", "question")
    return errors.recurring(failed, by=["o_orderkey"])


@check("e3_recurring_questions", _WITH + """
SELECT count(DISTINCT question) AS n_questions FROM (SELECT *, count(*) OVER (PARTITION BY db_name, question) AS n FROM r WHERE error_db_exec = 1) WHERE n > 1
""")
def recurring_questions(spark, sf_dir):
    return errors.distinct_questions(recurring_rows(spark, sf_dir))


@check("e4_bullets", _WITH + f"""
, n AS (SELECT {_SHORT} AS m, o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM r WHERE error_db_exec = 1)
SELECT rn AS place, '- ' || m AS line FROM n
""")
def bullet_texts(spark, sf_dir):
    failed = errors.execution_errors(runs(spark, sf_dir), ["db_name", "question", "o_orderkey", "error_msg_short"])
    return errors.bullets(failed, "error_msg_short", ["o_orderkey"])


@check("e5_valid_but_wrong", _WITH + """
SELECT o_orderkey, db_name, question, coalesce(instructions, '') AS instructions FROM r WHERE correct = 0 AND error_db_exec = 0
""")
def valid_but_wrong(spark, sf_dir):
    return errors.valid_but_wrong(runs(spark, sf_dir), ["o_orderkey", "db_name", "question", "instructions"])


@check("e6_first_of_each", _WITH + """
SELECT db_name, question, o_orderkey, error_msg FROM (SELECT *, row_number() OVER (PARTITION BY db_name, question ORDER BY o_orderkey) AS rn FROM r) WHERE rn = 1
""")
def first_of_each(spark, sf_dir):
    return errors.first_of_each(runs(spark, sf_dir).select("db_name", "question", "o_orderkey", "error_msg"), ["o_orderkey"])


_K = "o_orderkey"
_FEATURES = f"""
f AS (SELECT o_orderkey, correct, 2 + CASE WHEN {_K} % 4 = 0 THEN 0 ELSE 0 END AS sql_num_tables,
   4 + CASE WHEN {_K} % 7 = 0 THEN 2 ELSE 0 END + CASE WHEN {_K} % 2 = 0 THEN 1 ELSE 0 END AS sql_num_columns, 1 AS sql_joins, 1 AS sql_table_alias,
   1 AS sql_date_part, CASE WHEN {_K} % 7 = 0 THEN 1 ELSE 0 END AS sql_case_condition, CASE WHEN {_K} % 2 = 1 THEN 1 ELSE 0 END AS sql_group_by,
   CASE WHEN {_K} % 7 = 0 OR {_K} % 5 = 0 THEN 1 ELSE 0 END AS sql_order_by, CASE WHEN {_K} % 5 = 0 THEN 1 ELSE 0 END AS sql_limit,
   CASE WHEN {_K} % 3 = 0 THEN 1 ELSE 0 END AS sql_distinct, CASE WHEN {_K} % 2 = 1 THEN 1 ELSE 0 END AS sql_having,
   CASE WHEN {_K} % 7 = 0 THEN 1 ELSE 0 END AS sql_window, CASE WHEN {_K} % 4 = 0 THEN 1 ELSE 0 END AS sql_subquery,
   CASE WHEN {_K} % 4 = 0 THEN 1 ELSE 0 END AS sql_cte, CASE WHEN {_K} % 2 = 0 THEN 1 ELSE 0 END AS sql_like FROM r)
"""


@check("e7_sql_features", _WITH + "," + _FEATURES + "SELECT * EXCLUDE (correct) FROM f")
def sql_features(spark, sf_dir):
    return runs(spark, sf_dir).select("o_orderkey", errors.sql_features(F.col("query")).alias("f")).select("o_orderkey", "f.*")


@check("e8_feature_rows", _WITH + "," + _FEATURES + "SELECT correct, sql_num_columns, sql_order_by, count(*) AS n FROM f GROUP BY ALL")
def feature_rows(spark, sf_dir):
    flat = errors.feature_rows(runs(spark, sf_dir))
    return flat.groupBy("correct", "sql_num_columns", "sql_order_by").agg(F.count(F.lit(1)).alias("n"))


_SUMMED = "sql_date_part sql_case_condition sql_group_by sql_order_by sql_limit sql_distinct sql_having sql_window sql_subquery sql_cte sql_like".split()


@check("e9_feature_totals", _WITH + "," + _FEATURES + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, CAST(sum({n}) AS BIGINT) AS total FROM f WHERE correct = 0" for n in _SUMMED))
def feature_totals(spark, sf_dir):
    return errors.feature_totals(errors.feature_rows(runs(spark, sf_dir)))


@check("e10_totals_by_label", _WITH + "," + _FEATURES + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, CAST(sum({n}) FILTER (correct = 0) AS BIGINT) AS wrong, CAST(sum({n}) FILTER (correct = 1) AS BIGINT) AS \"right\" FROM f"
    for n in ["sql_num_tables", "sql_num_columns", "sql_joins", "sql_table_alias", *_SUMMED]))
def totals_by_label(spark, sf_dir):
    return errors.feature_totals_by_label(errors.feature_rows(runs(spark, sf_dir)))


@check("e11_feature_groups", _WITH + "," + _FEATURES + """
SELECT sql_date_part, sql_case_condition, sql_limit, count(*) AS n, round(avg(correct), 9) AS mean_correct FROM f GROUP BY ALL
""")
def feature_groups(spark, sf_dir):
    groups = errors.feature_groups(
        errors.feature_rows(runs(spark, sf_dir)), ["sql_date_part", "sql_case_condition", "sql_limit"]
    )
    return groups.withColumn("mean_correct", F.round("mean_correct", 9))


_NAMES = ", ".join(f"'{n}'" for n in _SUMMED)
_PRESENT = " + ".join(f"CASE WHEN {n} > 0 THEN {1 << i} ELSE 0 END" for i, n in enumerate(_SUMMED))


@check("e11_failing_together", _WITH + "," + _FEATURES + f"""
, p AS (SELECT {_PRESENT} AS has, count(*) FILTER (correct = 0) AS wrong, count(*) FILTER (correct = 1) AS good FROM f GROUP BY 1),
m AS (SELECT unnest(generate_series(1, {(1 << len(_SUMMED)) - 1})) AS mask),
t AS (SELECT mask, sum(wrong)::BIGINT AS n_wrong, sum(good)::BIGINT AS n_right FROM m JOIN p ON has & mask = mask GROUP BY mask HAVING sum(wrong) >= 20),
a AS (SELECT sum(wrong) AS w, sum(wrong + good) AS n FROM p)
SELECT array_to_string(list_filter([{_NAMES}], lambda x: (mask >> (list_position([{_NAMES}], x) - 1)) % 2 = 1), ' ') AS features,
       n_wrong, n_right, round(n_wrong / w, 9) AS support, round(n_wrong / (n_wrong + n_right) / (w / n), 9) AS lift FROM t, a
""")
def failing_together(spark, sf_dir):
    found = errors.failing_together(errors.feature_rows(runs(spark, sf_dir)))
    return found.select(F.array_join("features", " ").alias("features"), "n_wrong", "n_right", F.round("support", 9).alias("support"), F.round("lift", 9).alias("lift"))


@check("e12_summary_record", f"""
WITH r AS ({RUNS_DUCK}), c AS (SELECT query_category, avg(correct) AS rate FROM r WHERE query_category IS NOT NULL GROUP BY 1)
SELECT string_agg(concat(query_category, '=', printf('%.6f', rate)), ';' ORDER BY rate, query_category) AS categories,
       'execution' AS error_exec_summary, 'wrong' AS valid_wrong_summary FROM c
""")
def summary_record(spark, sf_dir):
    record = errors.summary_record(event_runs(spark, sf_dir), "execution", "wrong")
    parsed = record.select(
        F.from_json(
            "summary",
            "category_corr_dict MAP<STRING, DOUBLE>, error_exec_summary STRING, valid_wrong_summary STRING",
        ).alias("s")
    )
    entries = F.transform(
        F.map_entries("s.category_corr_dict"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.6f", e["value"]))
    )
    return parsed.select(F.array_join(entries, ";").alias("categories"), "s.error_exec_summary", "s.valid_wrong_summary")
