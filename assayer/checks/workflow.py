"""Checks of the translation workflow; one question row per customer with its orders as alternatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.checks import check
from assayer.operators import workflow as wf
from assayer.session import table

# Ordered alternatives per customer: text, validity and error of each order.
_ITEMS = """
i AS (SELECT o_custkey AS qid, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS alt,
             concat('SELECT ', o_orderkey, ' FROM ', o_orderpriority) AS sql, o_orderstatus <> 'P' AS valid,
             CASE WHEN o_orderstatus = 'P' THEN concat('no such column ', o_orderkey) ELSE '' END AS err FROM orders)
"""


def alternatives(spark, sf_dir):
    """(qid, sqls, valid, errs): one row per customer; a customer has few orders."""
    orders = table(spark, sf_dir, "orders")
    broken = F.col("o_orderstatus") == "P"
    item = F.struct(
        "o_orderkey",
        F.concat(F.lit("SELECT "), F.col("o_orderkey").cast("string"), F.lit(" FROM "), "o_orderpriority").alias("sql"),
        (~broken).alias("valid"),
        F.when(broken, F.concat(F.lit("no such column "), F.col("o_orderkey").cast("string"))).otherwise("").alias("err"),
    )
    grouped = orders.groupBy(F.col("o_custkey").alias("qid")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return grouped.select(
        "qid",
        F.transform("items", lambda i: i["sql"]).alias("sqls"),
        F.transform("items", lambda i: i["valid"]).alias("valid"),
        F.transform("items", lambda i: i["err"]).alias("errs"),
    )


@check("w1_map_alternatives", "WITH " + _ITEMS + """
SELECT qid, alt, replace(sql, 'FROM', 'from') AS sql, valid, err, lower(sql) AS regrouped FROM i
""")
def map_alternatives(spark, sf_dir):
    mapped = wf.map_list(
        alternatives(spark, sf_dir), "sqls", "mapped", lambda s: F.replace(s, F.lit("FROM"), F.lit("from"))
    ).drop("sqls")
    one = wf.per_alternative(mapped, {"mapped": "sql", "valid": "valid", "errs": "err"})
    back = wf.regroup(one.withColumn("low", F.lower("sql")), ["qid"], {"sql": "sqls", "low": "lows", "valid": "valids", "err": "errs"})
    again = wf.per_alternative(back, {"sqls": "sql", "lows": "regrouped", "valids": "valid", "errs": "err"})
    return again.withColumn("alt", F.col("alt").cast("bigint"))


@check("w2_invalid_rows", "WITH " + _ITEMS + """
SELECT qid, bool_or(NOT valid) AS some_invalid, bool_and(valid) AS none_invalid FROM i GROUP BY qid
""")
def invalid_rows(spark, sf_dir):
    return alternatives(spark, sf_dir).select(
        "qid", wf.any_invalid(F.col("valid")).alias("some_invalid"), wf.all_valid(F.col("valid")).alias("none_invalid")
    )


@check("w3_upsert", """
SELECT o_orderkey, CASE WHEN l_orderkey IS NOT NULL THEN concat('fixed ', n) ELSE o_orderpriority END AS o_orderpriority, o_orderstatus
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON o_orderkey = l_orderkey
""")
def upsert(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    fixes = returned.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.concat(F.lit("fixed "), F.count(F.lit(1)).cast("string")).alias("o_orderpriority")
    )
    return wf.upsert(base, fixes, "o_orderkey", ["o_orderpriority"])


_NOTED = """
CASE WHEN NOT valid THEN concat('<INVALID ERR MSG>: ', err, '-----------------<INVALID TRANSLATION>: ', sql,
     '-----------------<ORIG POSTGRES>: ', lower(sql), '-----------------') ELSE sql END
"""


def _annotated(spark, sf_dir):
    rows = alternatives(spark, sf_dir)
    origins = F.transform("sqls", F.lower)
    noted = wf.annotate_invalid(F.col("sqls"), F.col("valid"), F.col("errs"), origins)
    return rows.select("qid", noted.alias("noted"))


@check("w4_annotate_invalid", "WITH " + _ITEMS + f"SELECT qid, alt, {_NOTED} AS sql FROM i")
def annotate_invalid(spark, sf_dir):
    return _annotated(spark, sf_dir).select("qid", F.posexplode("noted").alias("alt", "sql")).withColumn(
        "alt", F.col("alt").cast("bigint")
    )


@check("w5_join_statements", "WITH " + _ITEMS + "SELECT qid, concat(string_agg(sql, ';' ORDER BY alt), ';') AS query FROM i GROUP BY qid")
def join_statements(spark, sf_dir):
    return alternatives(spark, sf_dir).select("qid", wf.join_statements(F.col("sqls")).alias("query"))


@check("w6_read_annotations", "WITH " + _ITEMS + "SELECT qid, alt, sql, err, valid FROM i")
def read_annotations(spark, sf_dir):
    text = _annotated(spark, sf_dir).select("qid", wf.join_statements(F.col("noted")).alias("query"))
    items = text.select("qid", F.posexplode(wf.read_annotations(F.col("query"))).alias("alt", "a"))
    return items.select("qid", F.col("alt").cast("bigint").alias("alt"), "a.sql", "a.err", "a.valid")


@check("w7_finish_table", """
SELECT 'shop' AS db_name, 'mysql' AS db_type, o_orderstatus AS query_category, concat('SELECT ', o_orderkey) AS query,
       concat('q', o_orderkey) AS question, coalesce(flag, '') AS note
FROM orders LEFT JOIN (SELECT l_orderkey, min(l_returnflag) AS flag FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
""")
def finish_table(spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("note"))
    orders = table(spark, sf_dir, "orders").join(flags, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key = F.col("o_orderkey").cast("string")
    raw = orders.select(
        "note", F.concat(F.lit("q"), key).alias("question"), F.lit("old").alias("query"), F.lit("postgres").alias("db_type"),
        F.concat(F.lit("SELECT "), key).alias("sql_mysql"), F.col("o_orderstatus").alias("query_category"),
        F.lit("shop").alias("db_name"), F.lit("x").alias("err_msg"),
    )
    return wf.finish_table(raw, "mysql", "sql_mysql", ["err_msg"])


@check("w8_contains_text", """
SELECT o_orderkey, coalesce(contains(lower(seg), 'buil'), false) AS hit
FROM orders LEFT JOIN (SELECT c_custkey, c_mktsegment AS seg FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey
""")
def contains_text(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    joined = table(spark, sf_dir, "orders").join(rich, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("o_orderkey", wf.contains_text(F.col("c_mktsegment"), "BuiL").alias("hit"))


@check("w9_without_repeats", """
SELECT o_custkey AS qid, string_agg(o_orderpriority, '|' ORDER BY first_at) AS seen
FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first_at FROM orders GROUP BY ALL) GROUP BY o_custkey
""")
def without_repeats(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    listed = orders.groupBy(F.col("o_custkey").alias("qid")).agg(
        F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("items")
    )
    words = F.transform("items", lambda i: i["o_orderpriority"])
    return listed.select("qid", F.array_join(wf.without_repeats(words), "|").alias("seen"))


@check("w10_update_if_valid", "WITH " + _ITEMS + """
SELECT qid, CASE WHEN qid % 3 = 0 AND bool_and(valid) THEN 'new' ELSE string_agg(sql, ';' ORDER BY alt) || ';' END AS query FROM i GROUP BY qid
""")
def update_if_valid(spark, sf_dir):
    rows = alternatives(spark, sf_dir).withColumn("query", wf.join_statements(F.col("sqls")))
    changed = wf.update_if_valid(rows, F.col("qid") % 3 == 0, F.col("valid"), {"query": F.lit("new")})
    return changed.select("qid", "query")


@check("w11_same_row", """
SELECT o_orderkey AS row_id, o_orderpriority AS translated, concat(o_orderstatus, o_custkey) AS original FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
""")
def same_row(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id")).distinct()
    sibling = orders.select(
        F.col("o_orderkey").alias("row_id"), F.concat("o_orderstatus", F.col("o_custkey").cast("string")).alias("query")
    )
    left = orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("translated")).join(
        lines, "row_id", "left_semi"
    )
    return wf.same_row(left, sibling, "row_id", {"query": "original"})


@check("w12_sample_one", "SELECT 1::BIGINT AS n_rows, 1::BIGINT AS n_members, 1::BIGINT AS n_repeated")
def sample_one(spark, sf_dir):
    """One row, a row of the table, and the same one again."""
    orders = table(spark, sf_dir, "orders")
    picked, again = (wf.sample_one(orders, "o_orderkey", seed=11) for _ in range(2))
    members = picked.join(orders, orders.columns, "left_semi").agg(F.count(F.lit(1)).alias("n_members"))
    repeated = picked.join(again, orders.columns, "left_semi").agg(F.count(F.lit(1)).alias("n_repeated"))
    counted = picked.agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.crossJoin(F.broadcast(members)).crossJoin(F.broadcast(repeated))


@check("w13_distinct_values", "SELECT lang AS value, (SELECT count(DISTINCT lang) FROM documents) AS n_values FROM documents GROUP BY lang")
def distinct_values(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    counted = documents.agg(F.count_distinct("lang").alias("n_values"))
    return documents.select(F.col("lang").alias("value")).distinct().crossJoin(F.broadcast(counted))
