"""Checks of the analytical workload on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.checks import check
from assayer.plans import gold
from assayer.session import table

AS_OF = "2001-08-01"
_SUM = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"


def _t(spark, sf_dir, *names):
    return [table(spark, sf_dir, n) for n in names]


@check("g1_join_group_order_limit", f"""
SELECT c_mktsegment, count(o_orderkey) AS n_orders, {_SUM.format('o_totalprice')} AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1 ORDER BY revenue DESC, c_mktsegment LIMIT 3
""")
def join_group_order_limit(spark, sf_dir):
    customer, orders = _t(spark, sf_dir, "customer", "orders")
    joined = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"))
    return gold.top_groups(
        joined, ["c_mktsegment"],
        {"n_orders": F.count("o_orderkey"), "revenue": gold.money(F.col("o_totalprice"))},
        [F.desc("revenue"), F.asc("c_mktsegment")], 3,
    )


@check("g2_last_days", f"""
SELECT c_mktsegment, count(*) AS n_orders, {_SUM.format('o_totalprice')} AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL '150 days'
GROUP BY 1 ORDER BY revenue DESC, 1 LIMIT 5
""")
def last_days(spark, sf_dir):
    customer, orders = _t(spark, sf_dir, "customer", "orders")
    recent = gold.since_days(orders, "o_orderdate", AS_OF, 150)
    joined = customer.join(recent, F.col("c_custkey") == F.col("o_custkey"))
    return gold.top_groups(
        joined, ["c_mktsegment"], {"n_orders": F.count(F.lit(1)), "revenue": gold.money(F.col("o_totalprice"))},
        [F.desc("revenue"), F.asc("c_mktsegment")], 5,
    )


@check("g3_last_months", f"""
SELECT n_name, count(*) AS n_orders, {_SUM.format('o_totalprice')} AS revenue, 'rolling' AS kind
FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey
WHERE o_orderdate >= DATE '{AS_OF}' - INTERVAL '3 months' GROUP BY 1
UNION ALL
SELECT n_name, count(*), {_SUM.format('o_totalprice')}, 'whole'
FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey
WHERE o_orderdate >= date_trunc('month', DATE '{AS_OF}' - INTERVAL '6 months') GROUP BY 1
""")
def last_months(spark, sf_dir):
    nation, customer, orders = _t(spark, sf_dir, "nation", "customer", "orders")
    people = nation.join(customer, F.col("n_nationkey") == F.col("c_nationkey"))

    def by_nation(months, whole, kind):
        recent = gold.since_months(orders, "o_orderdate", AS_OF, months, whole)
        joined = people.join(recent, F.col("c_custkey") == F.col("o_custkey"))
        return joined.groupBy("n_name").agg(
            F.count(F.lit(1)).alias("n_orders"), gold.money(F.col("o_totalprice")).alias("revenue"), F.lit(kind).alias("kind")
        )

    return by_nation(3, False, "rolling").unionByName(by_nation(6, True, "whole"))


@check("g4_closed_range", """
SELECT o_orderpriority, count(DISTINCT o_custkey) AS n_customers, round(avg(o_totalprice), 4) AS avg_price
FROM orders WHERE o_orderdate BETWEEN '1997-01-01' AND '1997-03-31 23:59:59' GROUP BY 1 ORDER BY n_customers DESC, 1 LIMIT 3
""")
def closed_range(spark, sf_dir):
    (orders,) = _t(spark, sf_dir, "orders")
    quarter = gold.between_days(orders, "o_orderdate", "1997-01-01", "1997-03-31 23:59:59")
    return gold.top_groups(
        quarter, ["o_orderpriority"],
        {"n_customers": F.count_distinct("o_custkey"), "avg_price": F.round(F.avg("o_totalprice"), 4)},
        [F.desc("n_customers"), F.asc("o_orderpriority")], 3,
    )


@check("g5_month_distinct", """
SELECT CAST(date_trunc('month', o_orderdate) AS VARCHAR)[:10] AS month, CAST(date_trunc('month', o_orderdate)::DATE AS VARCHAR) AS day_month,
       count(DISTINCT o_custkey) AS n_customers
FROM orders WHERE o_orderdate >= '1998-01-01' AND o_orderdate < '2000-01-01' GROUP BY 1, 2
""")
def month_distinct(spark, sf_dir):
    (orders,) = _t(spark, sf_dir, "orders")
    years = gold.half_open(orders, "o_orderdate", "1998-01-01", "2000-01-01")
    stamp = F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd")
    return years.groupBy(
        stamp.alias("month"), gold.month_start("o_orderdate").cast("string").alias("day_month")
    ).agg(F.count_distinct("o_custkey").alias("n_customers"))


@check("g6_group_top", """
SELECT user_id, count(*) AS n_events FROM events GROUP BY 1 ORDER BY n_events DESC, user_id LIMIT 10
""")
def group_top(spark, sf_dir):
    (events,) = _t(spark, sf_dir, "events")
    return gold.top_groups(events, ["user_id"], {"n_events": F.count(F.lit(1))}, [F.desc("n_events"), F.asc("user_id")], 10)


@check("g7_distinct_join", "SELECT DISTINCT c_custkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'P'")
def distinct_join(spark, sf_dir):
    customer, orders = _t(spark, sf_dir, "customer", "orders")
    return gold.distinct_partners(
        customer, orders.filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), ["c_custkey"]
    )


@check("g7_distinct_three_way", """
SELECT DISTINCT c_custkey, c_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_returnflag = 'R' AND l_quantity > 45
""")
def distinct_three_way(spark, sf_dir):
    customer, orders, lineitem = _t(spark, sf_dir, "customer", "orders", "lineitem")
    returned = lineitem.filter("l_returnflag = 'R' AND l_quantity > 45")
    bought = orders.join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return gold.distinct_partners(customer, bought, F.col("c_custkey") == F.col("o_custkey"), ["c_custkey", "c_name"])


@check("g8_distinct_filter", "SELECT DISTINCT user_id FROM events WHERE event_type = 'error'")
def distinct_filter(spark, sf_dir):
    (events,) = _t(spark, sf_dir, "events")
    return events.filter("event_type = 'error'").select("user_id").distinct()


@check("g9_orders_without_items", """
SELECT o.o_orderkey, o.o_custkey FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_orderkey IS NULL
""")
def orders_without_items(spark, sf_dir):
    orders, lineitem = _t(spark, sf_dir, "orders", "lineitem")
    return gold.without_partner(orders, lineitem, F.col("o_orderkey") == F.col("l_orderkey"), ["o_orderkey", "o_custkey"])


@check("g9_documents_without_labels", """
SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL
""")
def documents_without_labels(spark, sf_dir):
    documents, labels = _t(spark, sf_dir, "documents", "labels")
    return gold.without_partner(documents, labels, documents.doc_id == labels.doc_id, ["doc_id", "lang"])


@check("g10_aggregates", f"""
SELECT l_returnflag, l_linestatus, count(*) AS n_rows, count(l_shipdate) AS n_dates, count(DISTINCT l_orderkey) AS n_orders,
       {_SUM.format('l_extendedprice')} AS revenue, round(avg(l_quantity), 6) AS avg_qty, max(l_extendedprice) AS top_price
FROM lineitem GROUP BY 1, 2
""")
def aggregates(spark, sf_dir):
    (lineitem,) = _t(spark, sf_dir, "lineitem")
    return lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("l_shipdate").alias("n_dates"),
        F.count_distinct("l_orderkey").alias("n_orders"),
        gold.money(F.col("l_extendedprice")).alias("revenue"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.max("l_extendedprice").alias("top_price"),
    )


@check("g11_hidden_group_key", f"""
SELECT c_name, c_mktsegment, count(o_orderkey) AS n_orders, {_SUM.format('o_totalprice')} AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_name, c_mktsegment, c_custkey ORDER BY n_orders DESC, revenue DESC, c_custkey LIMIT 5
""")
def hidden_group_key(spark, sf_dir):
    customer, orders = _t(spark, sf_dir, "customer", "orders")
    joined = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"))
    return gold.top_groups(
        joined, ["c_name", "c_mktsegment", "c_custkey"],
        {"n_orders": F.count("o_orderkey"), "revenue": gold.money(F.col("o_totalprice"))},
        [F.desc("n_orders"), F.desc("revenue"), F.asc("c_custkey")], 5, drop=["c_custkey"],
    )


@check("g12_mixed_order", f"""
SELECT p_brand, count(*) AS n_items, round(avg(l_extendedprice), 4) AS avg_price
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY n_items DESC, avg_price ASC NULLS LAST, p_brand LIMIT 7
""")
def mixed_order(spark, sf_dir):
    lineitem, part = _t(spark, sf_dir, "lineitem", "part")
    joined = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return gold.top_groups(
        joined, ["p_brand"], {"n_items": F.count(F.lit(1)), "avg_price": F.round(F.avg("l_extendedprice"), 4)},
        [F.desc("n_items"), F.asc_nulls_last("avg_price"), F.asc("p_brand")], 7,
    )


@check("g13_joined_keys", """
SELECT n_name, c_mktsegment, count(*) AS n_orders FROM nation JOIN customer ON n_nationkey = c_nationkey
JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2 ORDER BY n_orders DESC, 1, 2 LIMIT 20
""")
def joined_keys(spark, sf_dir):
    nation, customer, orders = _t(spark, sf_dir, "nation", "customer", "orders")
    joined = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).join(
        nation, F.col("n_nationkey") == F.col("c_nationkey")
    )
    return gold.top_groups(
        joined, ["n_name", "c_mktsegment"], {"n_orders": F.count(F.lit(1))},
        [F.desc("n_orders"), F.asc("n_name"), F.asc("c_mktsegment")], 20,
    )


@check("g14_rank_of_groups", f"""
WITH r AS (SELECT n_name, {_SUM.format('o_totalprice')} AS revenue FROM nation JOIN customer ON n_nationkey = c_nationkey
JOIN orders ON c_custkey = o_custkey GROUP BY 1) SELECT *, rank() OVER (ORDER BY revenue DESC) AS place FROM r
""")
def rank_of_groups(spark, sf_dir):
    nation, customer, orders = _t(spark, sf_dir, "nation", "customer", "orders")
    joined = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).join(
        nation, F.col("n_nationkey") == F.col("c_nationkey")
    )
    ranked = gold.ranked_groups(joined, ["n_name"], gold.money(F.col("o_totalprice")), "revenue")
    return ranked.withColumn("place", F.col("place").cast("bigint"))


@check("g15_null_order", """
SELECT o_orderkey, lines, row_number() OVER (ORDER BY lines DESC NULLS FIRST, o_orderkey) AS nulls_first,
       row_number() OVER (ORDER BY CASE WHEN lines IS NULL THEN 1 ELSE 0 END, lines, o_orderkey) AS nulls_last
FROM (SELECT o_orderkey, max(l_linenumber) AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
""")
def null_order(spark, sf_dir):
    from assayer.operators.ordered import ranked

    orders, lineitem = _t(spark, sf_dir, "orders", "lineitem")
    counted = (
        orders.join(lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy("o_orderkey")
        .agg(F.max("l_linenumber").alias("lines"))
    )
    missing = F.col("lines").isNull()
    keyed = counted.withColumns(
        {"head": F.when(missing, 0).otherwise(1), "tail": F.when(missing, 1).otherwise(0), "fall": -F.col("lines")}
    )
    first = ranked(keyed, [], ["head", "fall", "o_orderkey"], into="nulls_first")
    both = ranked(first, [], ["tail", "lines", "o_orderkey"], into="nulls_last")
    return both.select("o_orderkey", "lines", "nulls_first", "nulls_last")


@check("g16_month_forms", """
SELECT strftime(make_date(year(ts)::BIGINT, month(ts)::BIGINT, 1), '%Y-%m-%d') AS month_date, strftime(ts, '%Y-%m') AS month_name,
       event_type, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, event_type, month_date LIMIT 4
""")
def month_forms(spark, sf_dir):
    (events,) = _t(spark, sf_dir, "events")
    return gold.top_groups(
        events.select(
            gold.month_from_parts("ts").cast("string").alias("month_date"), gold.month_text("ts").alias("month_name"), "event_type"
        ),
        ["month_date", "month_name", "event_type"], {"n": F.count(F.lit(1))}, [F.desc("n"), F.asc("event_type"), F.asc("month_date")], 4,
    )


@check("g17_several_statements", """
WITH m AS (SELECT date_trunc('month', ts) AS month, count(DISTINCT user_id) AS users FROM events GROUP BY 1)
SELECT 0::BIGINT AS qid, count(*) > 0 AS exact, count(*) > 0 AS correct, 1 AS exact_alt FROM m
""")
def several_statements(spark, sf_dir):
    from assayer.plans.evaluate import RunOptions, evaluate_run

    gold_text = (
        "SELECT date_trunc('month', ts) AS MONTH, COUNT(DISTINCT user_id) AS users FROM events GROUP BY 1 ORDER BY 1;"
        "SELECT CAST(date_trunc('month', ts) AS DATE) AS MONTH, COUNT(DISTINCT user_id) AS n FROM events GROUP BY 1 ORDER BY MONTH ASC;"
    )
    answer = "```sql\nSELECT trunc(ts, 'MM') AS m, count(DISTINCT user_id) AS u FROM events GROUP BY 1\n```"
    questions = spark.createDataFrame(
        [(0, "shop", "basic", "How many users per month?", gold_text)],
        "qid bigint, db_name string, query_category string, question string, query string",
    )
    responses = spark.createDataFrame([(0, answer)], "qid bigint, content string")
    run = evaluate_run(spark, questions, responses, sf_dir, RunOptions(seconds=60.0))
    return run.select(
        "qid", (F.col("exact_match") == 1).alias("exact"), (F.col("correct") == 1).alias("correct"), "exact_alt"
    )
