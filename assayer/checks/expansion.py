"""Checks of gold-text expansion; the texts are built from customer rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.checks import check
from assayer.operators import expand
from assayer.session import table

# The same text on both sides: one to four brace options, a repeat mark, a
# second statement and empty statements, depending on the customer key.
TEXT_SQL = """
SELECT c_custkey,
       concat(CASE WHEN c_custkey % 5 = 4 THEN concat('SELECT c_acctbal FROM customer WHERE c_name = "', c_name, '"')
                   ELSE concat('SELECT {c_name',
                               CASE WHEN c_custkey % 5 >= 1 THEN ',c_mktsegment' ELSE '' END,
                               CASE WHEN c_custkey % 5 >= 2 THEN ', c_nationkey' ELSE '' END,
                               CASE WHEN c_custkey % 5 >= 3 THEN ', c_custkey' ELSE '' END,
                               '}, COUNT(*) FROM customer WHERE c_mktsegment = "', c_mktsegment, '" GROUP BY {}') END,
              CASE WHEN c_custkey % 3 = 0 THEN '; SELECT {x,y} FROM t ;;' WHEN c_custkey % 3 = 1 THEN ' ;' ELSE '' END) AS query
FROM customer
"""


def gold_texts(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql(TEXT_SQL)


_SPLIT = f"""
WITH t AS ({TEXT_SQL}),
s AS (SELECT c_custkey, generate_subscripts(string_split(query, ';'), 1) AS i, unnest(string_split(query, ';')) AS raw FROM t),
k AS (SELECT c_custkey, i, trim(raw) AS stmt FROM s WHERE trim(raw) <> '')
"""


@check(
    "q1_split_statements",
    _SPLIT + "SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY i) - 1 AS alt, stmt FROM k",
)
def split_statements(spark, sf_dir):
    texts = gold_texts(spark, sf_dir)
    return texts.select("c_custkey", F.posexplode(expand.statements(F.col("query"))).alias("p", "stmt")).select(
        "c_custkey", F.col("p").cast("bigint").alias("alt"), "stmt"
    )


@check(
    "q2_brace_span",
    """
SELECT c_custkey,
       CASE WHEN s > 0 AND e > 0 THEN s - 1 ELSE -1 END AS start_at,
       CASE WHEN s > 0 AND e > 0 THEN s + e - 1 ELSE -1 END AS end_at
FROM (SELECT c_custkey, instr(q, '{') AS s,
             CASE WHEN instr(q, '{') > 0 THEN instr(substr(q, instr(q, '{') + 1), '}') ELSE 0 END AS e
      FROM (SELECT c_custkey, concat(CASE WHEN c_custkey % 4 = 0 THEN '} ' ELSE '' END, c_name,
                                     CASE WHEN c_custkey % 3 > 0 THEN '{' ELSE '' END, c_mktsegment,
                                     CASE WHEN c_custkey % 2 = 0 THEN '}' ELSE '' END) AS q FROM customer))
""",
)
def brace_span(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    texts = spark.sql(
        "SELECT c_custkey, concat(CASE WHEN c_custkey % 4 = 0 THEN '} ' ELSE '' END, c_name,"
        " CASE WHEN c_custkey % 3 > 0 THEN '{' ELSE '' END, c_mktsegment,"
        " CASE WHEN c_custkey % 2 = 0 THEN '}' ELSE '' END) AS q FROM customer"
    )
    span = expand.brace_span(F.col("q"))
    return texts.select(
        "c_custkey", span["start"].cast("bigint").alias("start_at"), span["end"].cast("bigint").alias("end_at")
    )


_VARIANTS = (
    _SPLIT
    + """,
b AS (SELECT c_custkey, i, stmt, instr(stmt, '{') AS s, instr(stmt, '}') AS e FROM k),
o AS (SELECT *, string_split(substr(stmt, s + 1, e - s - 1), ',') AS opts FROM b WHERE s > 0),
m AS (SELECT *, unnest(generate_series(1, CAST(pow(2, len(opts)) AS BIGINT) - 1)) AS mask FROM o),
c AS (SELECT *, list_filter(generate_series(1, len(opts)), lambda j: (mask >> (j - 1)) % 2 = 1) AS picks FROM m),
x AS (SELECT c_custkey, i, len(picks) AS n, picks, stmt, s, e,
             array_to_string(list_transform(picks, lambda j: opts[j]), ', ') AS cols FROM c),
v AS (SELECT c_custkey, i, n, picks,
             concat(substr(stmt, 1, s - 1), cols, replace(substr(stmt, e + 1), 'GROUP BY {}', concat('GROUP BY ', cols))) AS sql FROM x
      UNION ALL SELECT c_custkey, i, 0, CAST([] AS BIGINT[]), stmt FROM b WHERE s = 0)
"""
)


@check("q3_brace_subsets", _VARIANTS + """
SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY i, n, picks) - 1 AS alt, sql FROM v
""")
def brace_subsets(spark, sf_dir):
    expanded = expand.expand_gold(gold_texts(spark, sf_dir))
    return expanded.select("c_custkey", F.col("alt").cast("bigint").alias("alt"), "sql")


@check("q4_group_by_slot", _VARIANTS + """
SELECT c_custkey, count(*) AS n_texts, sum(CASE WHEN sql LIKE '%GROUP BY {}%' THEN 1 ELSE 0 END)::BIGINT AS open_slots,
       count(DISTINCT regexp_extract(sql, 'GROUP BY (.*)$', 1)) AS groupings, max(length(sql)) AS longest
FROM v GROUP BY c_custkey
""")
def group_by_slot(spark, sf_dir):
    texts = gold_texts(spark, sf_dir)
    # Grouped where the alternatives are made: Spark would join the small parts of a shuffle to a few tasks that hold much.
    expanded = expand.expand_gold(texts, by="c_custkey", rows=texts.count())
    return expanded.groupBy("c_custkey").agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.sum(F.contains("sql", F.lit("GROUP BY {}")).cast("long")).alias("open_slots"),
        F.count_distinct(F.regexp_extract("sql", "GROUP BY (.*)$", 1)).alias("groupings"),
        F.max(F.length("sql")).cast("bigint").alias("longest"),
    )


# Seventy options: the first thousand alternatives have one or two columns.
@check("q3_first_alternatives", """
WITH o AS (SELECT i, j, concat('c', i, CASE WHEN j < 70 THEN concat(', c', j) ELSE '' END) AS cols
           FROM generate_series(0, 69) a(i), generate_series(1, 70) b(j) WHERE j > i),
r AS (SELECT cols, row_number() OVER (ORDER BY j < 70, i, j) - 1 AS alt FROM o)
SELECT n_nationkey, alt, concat('SELECT ', cols, ' FROM ', n_name, ' GROUP BY ', cols) AS sql
FROM nation, r WHERE alt < 1000
""")
def first_alternatives(spark, sf_dir):
    options = F.lit(",".join(f"c{i}" for i in range(70)))
    texts = table(spark, sf_dir, "nation").select(
        "n_nationkey", F.concat(F.lit("SELECT {"), options, F.lit("} FROM "), "n_name", F.lit(" GROUP BY {}; SELECT 1")).alias("query")
    )
    return expand.expand_gold(texts, first=1000).select("n_nationkey", F.col("alt").cast("bigint").alias("alt"), "sql")


@check("q5_escape_percent", r"""
WITH t AS (SELECT c_custkey, concat('SELECT 100 % 7, c_name FROM customer WHERE c_name ',
       CASE c_custkey % 4 WHEN 0 THEN 'LIKE' WHEN 1 THEN 'ilike' WHEN 2 THEN 'like' ELSE '=' END, ' ''%', c_mktsegment, '%''',
       CASE WHEN c_custkey % 2 = 0 THEN concat(' AND c_name <> ''', c_name, '%'' LIMIT 5 % 3') ELSE '' END) AS q FROM customer),
p AS (SELECT c_custkey, q, regexp_extract(q, '(?is)^(.*?)(LIKE.*'')(.*)$', 1) AS a,
       regexp_extract(q, '(?is)^(.*?)(LIKE.*'')(.*)$', 2) AS m, regexp_extract(q, '(?is)^(.*?)(LIKE.*'')(.*)$', 3) AS z FROM t)
SELECT c_custkey, CASE WHEN m = '' THEN q ELSE concat(a, replace(m, '%', '%%'), z) END AS sql FROM p
""")
def escape_percent(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    texts = spark.sql(
        "SELECT c_custkey, concat('SELECT 100 % 7, c_name FROM customer WHERE c_name ',"
        " CASE c_custkey % 4 WHEN 0 THEN 'LIKE' WHEN 1 THEN 'ilike' WHEN 2 THEN 'like' ELSE '=' END,"
        " ' \\'%', c_mktsegment, '%\\'',"
        " CASE WHEN c_custkey % 2 = 0 THEN concat(' AND c_name <> \\'', c_name, '%\\' LIMIT 5 % 3') ELSE '' END) AS q"
        " FROM customer"
    )
    return texts.select("c_custkey", expand.escape_percent(F.col("q")).alias("sql"))
