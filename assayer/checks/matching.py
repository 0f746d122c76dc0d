"""Checks of canonical forms, matching and scoring.

One pair per nation: the gold result lists the customers of the nation, the
generated one is a copy changed by ``nation % 7``: 0 same, 1 rows reversed,
2 columns renamed, 3 an extra column, 4 one cell changed, 5 one row dropped,
6 relative noise of 1e-9 on a floating column.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assayer.checks import check
from assayer.functions.cells import round_half_even
from assayer.functions.ordering import stated_order, wants_order
from assayer.operators import capture, pairwise, score
from assayer.operators.outcome import outcome_columns
from assayer.session import table

PAIRS_SQL = """
SELECT c_nationkey AS pair_id, c_nationkey % 7 AS v, c_custkey AS a, c_acctbal AS b, c_mktsegment AS c,
       row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS p,
       count(*) OVER (PARTITION BY c_nationkey) AS n
FROM customer
"""
GEN_SQL = f"""
SELECT pair_id, v, a, CASE WHEN v = 6 THEN b * (1 + 1e-9) ELSE b END AS b,
       CASE WHEN v = 4 AND p = 0 THEN 'CHANGED' ELSE c END AS c,
       CASE WHEN v = 1 THEN n - 1 - p WHEN v = 5 THEN p - 1 ELSE p END AS p
FROM ({PAIRS_SQL}) WHERE NOT (v = 5 AND p = 0)
"""


def pair_rows(spark, sf_dir):
    """The long rows of all nation pairs, both sides."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    gold, gen = spark.sql(PAIRS_SQL), spark.sql(GEN_SQL.replace("1e-9", "1e-9D"))
    left = capture.long_rows(gold, F.col("pair_id"), "gold", F.col("p"), ["a", "b", "c"], 0)
    plain = capture.long_rows(gen, F.col("pair_id"), "gen", F.col("p"), ["a", "b", "c"])
    wide = F.array(
        F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")
    )
    renamed = F.array(F.lit("x"), F.lit("y"), F.lit("z"))
    more = F.struct(F.lit("#").alias("kind"), F.col("v").cast("double").alias("num"), F.lit(None).cast("string").alias("txt"))
    v = (F.col("pair_id") % 7).alias("v")
    right = (
        plain.withColumn("v", v)
        .withColumn("names", F.when(F.col("v") == 2, renamed).when(F.col("v") == 3, wide).otherwise(F.col("names")))
        .withColumn("vals", F.when(F.col("v") == 3, F.concat("vals", F.array(more))).otherwise(F.col("vals")))
        .withColumn("tags", F.when(F.col("v") == 3, F.concat("tags", F.array(F.lit("n")))).otherwise(F.col("tags")))
        .drop("v")
    )
    return left.unionByName(right)


def plain_questions(spark, rows):
    return rows.select("pair_id").distinct().select(
        "pair_id",
        F.lit("basic_join").alias("query_category"),
        F.lit("Which customers live there?").alias("question"),
        F.lit("SELECT a, b, c FROM customer").alias("sql_gold"),
        F.lit("SELECT a, b, c FROM customer").alias("sql_gen"),
    )


def pair_plan(spark, rows):
    plan = score.comparison_plan(score.result_heads(rows), plain_questions(spark, rows))
    return score.materialise(plan)


# What the scores must be, found by a full join of both sides on the key.
_CLOSE = "abs(g.b - n.b) <= greatest(1e-5 * greatest(abs(g.b), abs(n.b)), 1e-8)"
PAIR_ORACLE = f"""
WITH gold AS ({PAIRS_SQL}), gen AS ({GEN_SQL}),
j AS (SELECT coalesce(g.pair_id, n.pair_id) AS pair_id,
             g.a IS NOT NULL AND n.a IS NOT NULL AND g.b = n.b AND g.c = n.c AS same,
             g.a IS NOT NULL AND n.a IS NOT NULL AND {_CLOSE} AND g.c = n.c AS near
      FROM gold g FULL JOIN gen n ON g.pair_id = n.pair_id AND g.a = n.a),
s AS (SELECT pair_id::BIGINT AS pair_id, bool_and(same) AND pair_id % 7 <> 3 AS exact, bool_and(near) AS subset
      FROM j GROUP BY pair_id)
"""


@check("c1_unique_names", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'a_0,b,a_2' WHEN o_orderstatus = 'O' THEN 'b_0,b_1,b_2' ELSE 'a,b,c' END AS labels
FROM orders
""")
def unique_names(spark, sf_dir):
    status = F.col("o_orderstatus")
    names = (
        F.when(status == "F", F.split(F.lit("a,b,a"), ","))
        .when(status == "O", F.split(F.lit("b,b,b"), ","))
        .otherwise(F.split(F.lit("a,b,c"), ","))
    )
    orders = table(spark, sf_dir, "orders").withColumn("names", names)
    return orders.select("o_orderkey", F.array_join(capture.unique_names(F.col("names")), ",").alias("labels"))


@check("c2_distinct_rows", """
SELECT o_custkey, o_orderstatus, o_orderpriority, min(o_orderkey) AS pos FROM orders GROUP BY ALL
""")
def distinct_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    body = orders.select("o_custkey", "o_orderstatus", "o_orderpriority", F.col("o_orderkey").alias("pos"))
    return pairwise.drop_duplicates(body)


@check("c3_columns_by_name", """
SELECT pair_id::BIGINT AS pair_id, p AS pos, concat_ws('|', a, c, round(b, 2)::VARCHAR) AS row_text
FROM (SELECT c_nationkey AS pair_id, c_custkey AS a, c_acctbal AS b, c_mktsegment AS c,
             row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS p FROM customer)
""")
def columns_by_name(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    gold = spark.sql(PAIRS_SQL)
    # Upper-case names sort before lower-case ones: Key, Seg, bal.
    rows = capture.long_rows(
        gold, F.col("pair_id"), "gold", F.col("p"), ["b", "c", "a"], 0, names=["bal", "Seg", "Key"]
    )
    gen = rows.withColumns({"side": F.lit("gen"), "alt": F.lit(None).cast("int")})
    plan = pair_plan(spark, rows.unionByName(gen))
    sorted_rows = score.placed_rows(rows, plan)
    key, seg, bal = (F.get("canon", F.lit(i)) for i in range(3))
    return sorted_rows.select(
        "pair_id",
        "pos",
        F.concat_ws("|", key["num"].cast("bigint").cast("string"), seg["txt"], F.round(bal["num"], 2).cast("string")).alias("row_text"),
    )


_QUESTION_SQL = """
SELECT conv_id, turn, role, concat(text, CASE conv_id % 5 WHEN 0 THEN ' Sort by name.' WHEN 1 THEN ' sorted, ordered'
       WHEN 2 THEN ' (ARRANGE it)' WHEN 3 THEN ' border' ELSE ' in order' END) AS question,
       CASE WHEN turn % 4 = 3 THEN 'order_by' ELSE role END AS category FROM conversations
"""


@check("c4_ordering_intent", rf"""
SELECT conv_id, turn, category = 'order_by'
       OR regexp_matches(lower(question), '(^|[^\p{{L}}\p{{N}}_])(order|sort|arrange)([^\p{{L}}\p{{N}}_]|$)') AS intent
FROM ({_QUESTION_SQL})
""")
def ordering_intent(spark, sf_dir):
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    asked = spark.sql(_QUESTION_SQL)
    return asked.select("conv_id", "turn", wants_order(F.col("category"), F.col("question")).alias("intent"))


_ORDERED_SQL = """
SELECT o_orderkey, concat('SELECT * FROM orders o WHERE o_custkey = ', o_custkey,
   CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN ' ORDER BY o.o_totalprice DESC LIMIT 5'
     WHEN 2 THEN ' order by o_orderstatus' WHEN 3 THEN ' ORDER BY o_custkey ASC NULLS LAST, o_totalprice DESC;'
     WHEN 4 THEN concat(' ORDER BY', chr(10), 'o_totalprice DESC') WHEN 5 THEN concat(' ORDER BY o_totalprice', chr(10), 'LIMIT 3')
     WHEN 6 THEN ' ORDER BY count(x) DESC' ELSE ' ORDER BY a.b.o_orderpriority asc; -- x' END) AS sql FROM orders
"""


@check("c5_stated_order", """
SELECT o_orderkey, o_orderkey % 8 <> 0 AS stated,
       CASE o_orderkey % 8 WHEN 1 THEN 'o_totalprice,5' WHEN 2 THEN 'o_orderstatus' WHEN 3 THEN 'o_custkey'
            WHEN 6 THEN 'countx' WHEN 7 THEN 'o_orderpriority' ELSE '' END AS keys,
       o_orderkey % 8 NOT IN (3, 7) AS descending
FROM orders
""")
def stated_orders(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    texts = spark.sql(_ORDERED_SQL).select("o_orderkey", stated_order(F.col("sql")).alias("o"))
    return texts.select(
        "o_orderkey", "o.stated", F.array_join("o.keys", ",").alias("keys"), "o.descending"
    )


_RESULT_SQL = """
SELECT o.o_orderkey AS okey, o.o_orderpriority AS prio, c.c_mktsegment AS seg, o.o_orderkey AS pos
FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey
"""


def _left_joined(spark, sf_dir):
    for name in ("orders", "customer"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(_RESULT_SQL)


@check("c6_keyed_order", f"""
SELECT okey, prio, seg, row_number() OVER (ORDER BY seg DESC NULLS LAST, okey DESC NULLS LAST, prio DESC NULLS LAST) - 1 AS pos
FROM ({_RESULT_SQL})
""")
def keyed_order(spark, sf_dir):
    return pairwise.canonical_order(pairwise.by_name(_left_joined(spark, sf_dir)), ["seg"], descending=True)


@check("c7_plain_order", f"""
SELECT okey, prio, seg, row_number() OVER (ORDER BY seg NULLS LAST, okey NULLS LAST, prio NULLS LAST) - 1 AS pos
FROM (SELECT seg, prio, okey FROM ({_RESULT_SQL}))
""")
def plain_order(spark, sf_dir):
    return pairwise.canonical_order(_left_joined(spark, sf_dir), ["seg", "okey", "prio"])


@check("c8_normal_form", f"""
SELECT prio, seg, row_number() OVER (ORDER BY prio NULLS LAST, seg NULLS LAST) - 1 AS pos, 'none' AS mode
FROM (SELECT DISTINCT prio, seg FROM ({_RESULT_SQL}))
UNION ALL
SELECT prio, seg, row_number() OVER (ORDER BY seg DESC NULLS LAST, prio DESC NULLS LAST) - 1, 'keyed'
FROM (SELECT DISTINCT prio, seg FROM ({_RESULT_SQL}))
UNION ALL
SELECT prio, seg, row_number() OVER (ORDER BY first_at) - 1, 'raw'
FROM (SELECT prio, seg, min(pos) AS first_at FROM ({_RESULT_SQL}) GROUP BY prio, seg)
""")
def normal_form(spark, sf_dir):
    result = _left_joined(spark, sf_dir).select("seg", "prio", "pos")

    def form(mode, question, sql):
        normal = pairwise.normalise(result, "basic", question, sql)
        return normal.select("prio", "seg", "pos", F.lit(mode).alias("mode"))

    return (
        form("none", "Which segments?", None)
        .unionByName(form("keyed", "Sort the segments.", "SELECT * FROM r ORDER BY r.seg DESC"))
        .unionByName(form("raw", "Sort the segments.", "SELECT * FROM r"))
    )


@check("c9_round_half_even", """
SELECT l_orderkey, l_linenumber, count(*) AS n, sum(round_even(l_extendedprice * 100, 1)) / 100 AS cents3,
       max(round_even(l_quantity / 8 * 100, 0) / 100) AS eighths
FROM lineitem GROUP BY ALL
""".replace("sum(round_even(l_extendedprice * 100, 1)) / 100", "max(round_even(l_extendedprice * 10, 0) / 10)"))
def rounding(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(round_half_even(F.col("l_extendedprice"), 1)).alias("cents3"),
        F.max(round_half_even(F.col("l_quantity") / 8, 2)).alias("eighths"),
    )


@check("c10_positional_match", PAIR_ORACLE + """
SELECT pair_id, pair_id % 7 IN (0, 2) AND exact AS same_places FROM s WHERE pair_id % 7 <> 5
UNION ALL SELECT pair_id, false FROM s WHERE pair_id % 7 = 5
""")
def positional_match(spark, sf_dir):
    rows = pair_rows(spark, sf_dir)
    plan = pair_plan(spark, rows)
    same = score.positional_matches(score.column_profiles(score.planned_rows(rows, plan), plan))
    return plan.join(same, score.PAIR).select(
        "pair_id", (F.col("same_places") & (F.col("gold_cols") == F.col("gen_cols"))).alias("same_places")
    )


@check("c11_normal_match", PAIR_ORACLE + "SELECT pair_id, exact AS normal_equal FROM s")
def normal_match(spark, sf_dir):
    rows = pair_rows(spark, sf_dir)
    return score.exact_matches(rows, pair_plan(spark, rows)).select("pair_id", "normal_equal")


@check("c12_exact_match_frames", """
WITH a AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q, l_returnflag AS f FROM lineitem),
b AS (SELECT l_returnflag AS f, l_quantity AS q, l_linenumber AS n, l_orderkey AS k FROM lineitem)
SELECT (SELECT count(*) FROM (FROM a EXCEPT SELECT k, n, q, f FROM b)) = 0
   AND (SELECT count(*) FROM (SELECT k, n, q, f FROM b EXCEPT FROM a)) = 0 AS exact, true AS subset
""")
def exact_match_frames(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    gold = items.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"),
        F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("f"),
    )
    return pairwise.compare_frames(gold, gold.select("f", "q", "n", "k").repartition(8, "n"))


@check("c13_empty_gold", """
SELECT DISTINCT c_nationkey::BIGINT AS pair_id, r_name <> 'ASIA' AS exact, r_name <> 'ASIA' AS correct
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def empty_gold(spark, sf_dir):
    # The gold statement leaves out Asia, so its nations have an empty gold result.
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    kept = nation.join(region.filter("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = pair_rows(spark, sf_dir).filter("side = 'gold'")
    gold = rows.join(kept, F.col("pair_id") == F.col("n_nationkey"), "left_semi")
    gen = rows.withColumns({"side": F.lit("gen"), "alt": F.lit(None).cast("int")})
    marker = rows.select("pair_id", "alt", "side", "names", "tags", "err").distinct().withColumns(
        {"pos": F.lit(None).cast("bigint"), "vals": F.lit(None).cast(rows.schema["vals"].dataType)}
    )
    both = gold.unionByName(marker).unionByName(gen)
    return score.score_pairs(both, plain_questions(spark, rows)).select("pair_id", "exact", "correct")


@check("c14_column_candidates", PAIR_ORACLE + """
, cols AS (SELECT pair_id, v, list(a ORDER BY a) AS a, list(b ORDER BY b) AS b, list(c ORDER BY c) AS c FROM gold GROUP BY ALL),
gcols AS (SELECT pair_id, v, list(a ORDER BY a) AS a, list(b ORDER BY b) AS b, list(c ORDER BY c) AS c FROM gen GROUP BY ALL)
SELECT g.pair_id::BIGINT AS pair_id,
       concat(CASE WHEN g.a = n.a THEN '0:0 ' ELSE '' END,
              CASE WHEN len(g.b) = len(n.b) AND len(list_filter(list_zip(g.b, n.b), lambda z: abs(z[1] - z[2]) > greatest(1e-5 * greatest(abs(z[1]), abs(z[2])), 1e-8))) = 0 THEN '1:1 ' ELSE '' END,
              CASE WHEN g.c = n.c THEN '2:2 ' ELSE '' END) AS found
FROM cols g JOIN gcols n ON g.pair_id = n.pair_id
""")
def column_matches(spark, sf_dir):
    rows = pair_rows(spark, sf_dir)
    plan = pair_plan(spark, rows)
    planned = score.planned_rows(rows, plan)
    candidates = score.materialise(score.column_candidates(score.column_profiles(planned, plan)))
    close = score.tolerant_matches(planned, candidates.filter("not sure"))
    found = candidates.filter("sure").drop("sure").unionByName(close)
    text = F.concat(F.col("g_col").cast("string"), F.lit(":"), F.col("n_col").cast("string"), F.lit(" "))
    texts = found.groupBy("pair_id").agg(F.array_join(F.array_sort(F.collect_set(text)), "").alias("found"))
    pairs = rows.select("pair_id").distinct()
    return pairs.join(texts, "pair_id", "left").select("pair_id", F.coalesce("found", F.lit("")).alias("found"))


@check("c15_greedy_columns", """
SELECT o_custkey AS pair_id, CASE WHEN count(*) % 2 = 0 THEN '0,1' ELSE '1,0' END AS taken FROM orders GROUP BY o_custkey
""")
def greedy_columns(spark, sf_dir):
    # Gold column 0 matches generated 0 and 1 or only 1; gold column 1 the rest.
    pairs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("pair_id")).agg(F.count(F.lit(1)).alias("n"))
    even = F.col("n") % 2 == 0

    def match(g, n):
        return F.struct(F.lit(g).alias("g_col"), F.lit(n).alias("n_col"))

    options = F.when(even, F.array(match(1, 1), match(0, 1), match(0, 0))).otherwise(
        F.array(match(1, 0), match(1, 1), match(0, 1))
    )
    matches = pairs.select("pair_id", F.lit(0).alias("alt"), F.explode(options).alias("m")).select("pair_id", "alt", "m.*")
    return score.assign_columns(matches).select("pair_id", F.array_join("taken", ",").alias("taken"))


@check("c16_matched_projection", PAIR_ORACLE + "SELECT pair_id FROM s WHERE subset")
def matched_projection(spark, sf_dir):
    rows = pair_rows(spark, sf_dir)
    plan = pair_plan(spark, rows)
    planned = score.planned_rows(rows, plan)
    profiles = score.materialise(score.column_profiles(planned, plan))
    return score.subset_matches(rows, planned, profiles, plan).select("pair_id")


@check("c17_subset_match_frames", """
SELECT false AS exact, count(*) = (SELECT count(*) FROM lineitem) AS subset
FROM lineitem WHERE l_extendedprice = l_extendedprice * 1.0
""")
def subset_match_frames(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    gold = items.select("l_orderkey", "l_linenumber", "l_extendedprice")
    gen = items.select(
        F.col("l_shipdate").alias("d"), F.col("l_linenumber").alias("b"), F.col("l_extendedprice").alias("c"),
        F.col("l_returnflag").alias("e"), F.col("l_orderkey").alias("a"),
    )
    return pairwise.compare_frames(gold, gen)


@check("c17_subset_match_noise", """
SELECT bool_and(near) AND NOT bool_and(same) AS subset_only FROM (
  SELECT abs(a - b) <= greatest(1e-5 * greatest(abs(a), abs(b)), 1e-8) AS near, a = b AS same FROM (
    SELECT l_extendedprice AS a, l_extendedprice * (1 + 1e-9) AS b FROM lineitem))
""")
def subset_match_noise(spark, sf_dir):
    # A common factor keeps the order of the rows, so that they still line up.
    items = table(spark, sf_dir, "lineitem")
    gold = items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    gen = gold.withColumn("l_extendedprice", F.col("l_extendedprice") * (1 + 1e-9))
    verdict = pairwise.compare_frames(gold, gen)
    return verdict.select((F.col("subset") & ~F.col("exact")).alias("subset_only"))


@check("c18_score_pairs", PAIR_ORACLE + "SELECT pair_id, exact, exact OR subset AS correct FROM s")
def scored_pairs(spark, sf_dir):
    rows = pair_rows(spark, sf_dir)
    return score.score_pairs(rows, plain_questions(spark, rows)).select("pair_id", "exact", "correct")


@check("c18_fold_alternatives", """
WITH alts AS (SELECT o_custkey AS pair_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS alt,
                     o_orderstatus, o_orderpriority FROM orders),
f AS (SELECT pair_id, min(CASE WHEN o_orderstatus = 'O' THEN alt END) AS hit,
             min(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'O' THEN alt END) AS bad,
             bool_or(o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT') AS part FROM alts GROUP BY pair_id),
g AS (SELECT *, bad IS NOT NULL AND (hit IS NULL OR bad < hit) AS failed FROM f)
SELECT pair_id, NOT failed AND hit IS NOT NULL AS exact, NOT failed AND (hit IS NOT NULL OR part) AS correct,
       CASE WHEN NOT failed THEN hit END AS exact_alt, failed FROM g
""")
def fold_alternatives(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    alts = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("pair_id"), place.cast("int").alias("alt"), "o_orderstatus", "o_orderpriority"
    )
    broken = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") != "O")
    scored = alts.filter(~broken).select(
        "pair_id", "alt", (F.col("o_orderstatus") == "O").alias("exact"), (F.col("o_orderstatus") == "F").alias("subset")
    )
    outcomes = alts.select(
        "pair_id", "alt", F.lit("gold").alias("side"), F.when(broken, F.lit("boom")).alias("err")
    )
    folded = score.fold_alternatives(scored, outcomes)
    return folded.select("pair_id", "exact", "correct", F.col("exact_alt").cast("bigint").alias("exact_alt"), "failed")


@check("c19_outcome_columns", """
SELECT o_orderkey, CASE WHEN k IN (0, 5) THEN 1 ELSE 0 END AS exact_match, CASE WHEN k IN (0, 1, 5) THEN 1 ELSE 0 END AS correct,
       CASE WHEN k = 3 THEN 1 ELSE 0 END AS error_db_exec, CASE WHEN k IN (4, 6) THEN 1 ELSE 0 END AS error_query_gen,
       CASE WHEN k = 6 THEN 1 ELSE 0 END AS timeout,
       CASE k WHEN 2 THEN 'INCORRECT RESULTS' WHEN 3 THEN 'EXECUTION ERROR: no table'
              WHEN 4 THEN 'GENERATION ERROR: refused' WHEN 6 THEN 'API TIMEOUT' ELSE '' END AS error_msg
FROM (SELECT o_orderkey, o_orderkey % 7 AS k FROM orders)
""")
def outcomes(spark, sf_dir):
    k = F.col("o_orderkey") % 7
    runs = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        k.isin(0, 5).alias("exact"),
        k.isin(0, 1, 5).alias("correct"),
        F.when(k == 3, F.lit("no table")).alias("error"),
        F.when(k == 4, F.lit("refused")).alias("generation_error"),
        (k == 6).alias("timed_out"),
    )
    return outcome_columns(runs).select(
        "o_orderkey", "exact_match", "correct", "error_db_exec", "error_query_gen", "timeout", "error_msg"
    )
