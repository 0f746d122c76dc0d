"""Checks of schema metadata, DDL and instruction texts built from table rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.checks import check
from assayer.functions import metadata as md
from assayer.functions import prompts, rewrite
from assayer.functions.bind import let, present
from assayer.session import spread, table

# One DDL text per part; reads the same on both sides (no quotes, no escapes).
DDL_SQL = """
SELECT p_partkey, p_name, p_type, s,
  concat('CREATE TABLE ', s, 'part_', p_partkey, ' (', chr(10), '  id bigint PRIMARY KEY, --key of ', p_name, chr(10),
         '  long varchar UNIQUE,', chr(10), '  size numeric(10,2), --in mm, ', p_type, chr(10),
         '  made_at timestamp', chr(10), ');', chr(10),
         'CREATE TABLE ', CASE WHEN p_size % 2 = 0 THEN 'beta.' ELSE '' END, 'Lookup_', p_size, ' (', chr(10),
         '  order integer,', chr(10), '  name text --plain', chr(10), ');', chr(10)) AS ddl
FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'alpha.' WHEN 1 THEN 'beta.' ELSE '' END AS s FROM part)
"""


def ddl_texts(spark, sf_dir):
    spread(table(spark, sf_dir, "part"), "p_partkey").createOrReplaceTempView("part")
    return spark.sql(DDL_SQL)


_META = [
    (0, "people", 0, "id", "bigint"),
    (0, "people", 1, "full name", "text"),
    (1, "orders_of", 0, "order_id", "bigint"),
    (1, "orders_of", 1, "total", "double precision"),
    (1, "orders_of", 2, "note", "text"),
]
_META_SQL = ", ".join(str(r) for r in _META)
_META_ROWS = f"""
m AS (SELECT c_custkey, t.*, CASE WHEN (c_custkey + ord) % 2 = 0 THEN concat('of ', c_name, chr(10), 'x') ELSE '' END AS d
      FROM customer, (VALUES {_META_SQL.replace("'", "'")}) t(tab_ord, tab, ord, col, typ)),
l AS (SELECT *, concat('  ', CASE WHEN contains(col, ' ') THEN concat('"', col, '"') ELSE col END, ' ', typ,
                       CASE WHEN ord < max(ord) OVER (PARTITION BY c_custkey, tab) THEN ',' ELSE '' END,
                       CASE WHEN d <> '' THEN concat(' --', replace(d, chr(10), ' ')) ELSE '' END, chr(10)) AS line FROM m),
t AS (SELECT c_custkey, tab_ord, concat('CREATE TABLE ', tab, ' (', chr(10), string_agg(line, '' ORDER BY ord), ');', chr(10)) AS text
      FROM l GROUP BY c_custkey, tab_ord, tab)
"""


def metadata_rows(spark, sf_dir):
    fields = ("tab_ord", "table", "ord", "column_name", "data_type")
    listed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(fields, row)]) for row in _META])
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.explode(listed).alias("m")).select(
        "c_custkey", "c_name", "m.*"
    )
    note = F.when(
        (F.col("c_custkey") + F.col("ord")) % 2 == 0, F.concat(F.lit("of "), "c_name", F.lit("\nx"))
    ).otherwise("")
    return rows.withColumn("column_description", note)


@check("d1_create_table_text", "WITH " + _META_ROWS + "SELECT c_custkey, string_agg(text, '' ORDER BY tab_ord) AS ddl FROM t GROUP BY c_custkey")
def create_table_text(spark, sf_dir):
    return md.ddl_from_columns(metadata_rows(spark, sf_dir), ["c_custkey"])


@check("d1_shuffled_text", "WITH " + _META_ROWS + """
SELECT c_custkey, count(*) AS n_tables, sum(length(text))::BIGINT - 0 AS n_chars FROM t GROUP BY c_custkey
""".replace("sum(length(text))::BIGINT - 0", "sum(length(text) - (length(text) - length(replace(text, ',', ''))))::BIGINT"))
def shuffled_text(spark, sf_dir):
    shuffled = md.ddl_from_columns(metadata_rows(spark, sf_dir), ["c_custkey"], seed=7)
    bare = F.length(F.replace(F.col("ddl"), F.lit(","), F.lit("")))
    return shuffled.select(
        "c_custkey",
        F.size(md.table_names(F.col("ddl"))).cast("bigint").alias("n_tables"),
        bare.cast("bigint").alias("n_chars"),
    )


@check("d2_table_names", f"""
SELECT p_partkey, concat(s, 'part_', p_partkey, '|', CASE WHEN p_size % 2 = 0 THEN 'beta.' ELSE '' END, 'Lookup_', p_size) AS names
FROM (SELECT p_partkey, p_size, CASE p_partkey % 3 WHEN 0 THEN 'alpha.' WHEN 1 THEN 'beta.' ELSE '' END AS s FROM part)
""")
def table_names(spark, sf_dir):
    return ddl_texts(spark, sf_dir).select("p_partkey", F.array_join(md.table_names(F.col("ddl")), "|").alias("names"))


@check("d3_known_tables", f"""
WITH d AS ({DDL_SQL}), n AS (SELECT p_partkey, unnest(regexp_extract_all(ddl, 'CREATE TABLE ([^(]+)\\(', 1)) AS name FROM d)
SELECT p_partkey, string_agg(DISTINCT lower(trim(string_split(name, '.')[-1])), '|' ORDER BY lower(trim(string_split(name, '.')[-1]))) AS names
FROM n GROUP BY p_partkey
""")
def known_tables(spark, sf_dir):
    return ddl_texts(spark, sf_dir).select(
        "p_partkey", F.array_join(F.array_sort(md.known_tables(F.col("ddl"))), "|").alias("names")
    )


@check("d4_schema_names", f"""
WITH d AS ({DDL_SQL}), n AS (SELECT p_partkey, unnest(list_distinct(regexp_extract_all(ddl, 'CREATE TABLE ([a-zA-Z_]\\w*)\\.', 1))) AS name FROM d)
SELECT d.p_partkey, coalesce(string_agg(name, '|' ORDER BY name), '') AS names FROM d LEFT JOIN n USING (p_partkey) GROUP BY d.p_partkey
""")
def schema_names(spark, sf_dir):
    return ddl_texts(spark, sf_dir).select(
        "p_partkey", F.array_join(F.array_sort(md.schema_names(F.col("ddl"))), "|").alias("names")
    )


_SCHEMA_LINES = """
CASE WHEN contains(ddl, 'TABLE beta.') AND s <> 'beta.' THEN concat('CREATE SCHEMA IF NOT EXISTS beta;', chr(10)) ELSE '' END ||
CASE WHEN s <> '' THEN concat('CREATE SCHEMA IF NOT EXISTS ', replace(s, '.', ''), ';', chr(10)) ELSE '' END || ddl
"""


@check("d5_schema_lines", f"WITH d AS ({DDL_SQL}) SELECT p_partkey, {_SCHEMA_LINES} AS ddl FROM d")
def schema_lines(spark, sf_dir):
    return ddl_texts(spark, sf_dir).select("p_partkey", md.with_schema_lines(F.col("ddl")).alias("ddl"))


@check("d6_without_schemas", f"""
WITH d AS ({DDL_SQL})
SELECT p_partkey, replace(replace(ddl, 'TABLE alpha.', 'TABLE '), 'TABLE beta.', 'TABLE ') AS ddl,
       CASE WHEN contains(ddl, 'alpha.') AND contains(ddl, 'beta.') THEN concat('use part_', p_partkey, ' and x, not gamma.y')
            WHEN contains(ddl, 'alpha.') THEN concat('use part_', p_partkey, ' and beta.x, not gamma.y')
            WHEN contains(ddl, 'beta.') THEN concat('use alpha.part_', p_partkey, ' and x, not gamma.y')
            ELSE concat('use alpha.part_', p_partkey, ' and beta.x, not gamma.y') END AS text
FROM d
""")
def without_schemas(spark, sf_dir):
    texts = ddl_texts(spark, sf_dir)
    note = F.concat(F.lit("use alpha.part_"), F.col("p_partkey").cast("string"), F.lit(" and beta.x, not gamma.y"))
    return texts.select(
        "p_partkey",
        md.ddl_without_schemas(F.col("ddl")).alias("ddl"),
        md.without_schemas(note, F.col("ddl")).alias("text"),
    )


STATEMENT_SQL = """
SELECT p_partkey, ddl, concat('SELECT a FROM ', s, 'part_', p_partkey, ' p join ', 'LOOKUP_', p_partkey % 50, ' l ON p.x = l.y',
       CASE WHEN p_partkey % 2 = 0 THEN ' LEFT JOIN other.Unknown u ON u.z = 1' ELSE ' , (select 1 from t)' END) AS sql
FROM ({ddl})
""".format(ddl=DDL_SQL)


def statement_texts(spark, sf_dir):
    spread(table(spark, sf_dir, "part"), "p_partkey").createOrReplaceTempView("part")
    return spark.sql(STATEMENT_SQL)


@check("d7_referenced_tables", """
SELECT p_partkey, concat('part_', p_partkey, '|LOOKUP_', p_partkey % 50, CASE WHEN p_partkey % 2 = 0 THEN '|Unknown' ELSE '' END) AS names FROM part
""")
def referenced_tables(spark, sf_dir):
    return statement_texts(spark, sf_dir).select(
        "p_partkey", F.array_join(md.referenced_tables(F.col("sql")), "|").alias("names")
    )


@check("d7_tables_of_lists", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('orders_', p_partkey, '|customer') WHEN 1 THEN 'events|nation'
       WHEN 2 THEN 'orders|region' ELSE 'lineitem|part' END AS names FROM part
""")
def tables_of_lists(spark, sf_dir):
    """Comma joins, a FROM inside a function, names that WITH defines, schemas and quotes."""
    key = F.col("p_partkey")
    sql = (
        F.when(key % 4 == 0, F.concat(F.lit("SELECT EXTRACT(YEAR FROM o.created) FROM orders_"), key.cast("string"), F.lit(" AS o , customer c WHERE o.k = c.k")))
        .when(key % 4 == 1, F.lit("SELECT substring(e.name FROM 2), trim(both FROM x) FROM shop.events e,\n  shop.\"nation\" WHERE 1 = 1"))
        .when(key % 4 == 2, F.lit("WITH big AS (SELECT * FROM orders), few (a, b) AS (SELECT 1, 2) SELECT * FROM big, few JOIN region ON true"))
        .otherwise(F.lit("select * from lineitem l left join part on p = l, (select 1) x"))
    )
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.array_join(md.referenced_tables(sql), "|").alias("names"))


# Statements by order key and the tables a reader finds in them; {k} is a number of each row's own.
_HARD_STATEMENTS = [
    ("SELECT a FROM (SELECT a FROM orders_{k}) o, customer c", "orders_{k}|customer"),
    ("SELECT x IS NOT DISTINCT FROM ycol_{k} FROM orders WHERE a IS DISTINCT FROM b", "orders"),
    ("SELECT 1 FROM lineitem l JOIN part_{k} p ON p.x = l.y AND (p.z, 1) IN (SELECT 1, 2 FROM supplier), customer", "lineitem|part_{k}|supplier|customer"),
    ("SELECT ~ FROM nope, ~~no FROM~, -- FROM bad_{k}, worse{n} /* FROM odd */ 2 FROM nation /* , region */ n", "nation"),
    ("WITH orders AS (SELECT * FROM orders), few (a, b) AS (SELECT 1, k FROM part_{k}) SELECT * FROM orders, few, region", "orders|part_{k}|region"),
    ("WITH RECURSIVE up AS (SELECT 1 UNION ALL SELECT a FROM up, nation_{k}) SELECT * FROM up NATURAL JOIN region", "nation_{k}|region"),
    ("SELECT (WITH t AS (SELECT 1 FROM nation), deep AS (SELECT * FROM t) SELECT max(a) FROM deep) FROM deep, t_{k}", "nation|deep|t_{k}"),
    ("SELECT EXTRACT(YEAR FROM o.day), trim(both FROM x), count(*) FILTER (WHERE a) FROM shop.\"My Table\" m, `a.b.c_{k}` ORDER BY 1, 2", "My Table|c_{k}"),
    ("SELECT * FROM generate_series(1, {k}) g, (VALUES (1, x), (2, y)) v, LATERAL (SELECT 1 FROM events) e LEFT JOIN ((orders a CROSS JOIN part b) JOIN region r USING (k, j)) ON true, nation", "events|orders|part|region|nation"),
    ("SELECT a, b FROM orders o GROUP BY a, customer UNION SELECT 1 FROM orders_{k} FOR UPDATE; INSERT INTO copies SELECT * FROM [dbo].[Odd Name]", "orders|orders_{k}|copies|Odd Name"),
]


def _by_order_key(texts, join):
    """A SQL case over the order key: each text with {k} as a number, ~ as a quote and {n} as a line break."""
    def text(t):
        pieces = t.replace("{n}", "\n").replace("~", "''").split("{k}")
        quoted = [f"'{piece}'" for piece in pieces]
        return join.join(quoted).replace("\n", "' || chr(10) || '")

    return f"CASE o_orderkey % {len(texts)} " + " ".join(f"WHEN {i} THEN {text(t)}" for i, t in enumerate(texts)) + " END"


_KEY_JOIN = " || CAST(o_custkey AS VARCHAR(20)) || "


@check("d7_statement_tokens", f"SELECT o_orderkey, {_by_order_key([names for _, names in _HARD_STATEMENTS], _KEY_JOIN)} AS names FROM orders")
def statement_tokens(spark, sf_dir):
    """Derived tables, conditions, strings, comments, functions, definitions at any depth."""
    spread(table(spark, sf_dir, "orders"), "o_orderkey").createOrReplaceTempView("orders")
    sql = _by_order_key([sql for sql, _ in _HARD_STATEMENTS], _KEY_JOIN)
    texts = spark.sql(f"SELECT o_orderkey, {sql} AS sql FROM orders")
    return texts.select("o_orderkey", F.array_join(md.referenced_tables(F.col("sql")), "|").alias("names"))


_DATASET_DDL = "CREATE TABLE s1.Orders (\n  id int\n);\nCREATE TABLE nation (\n  id int\n);"
_DATASET_STATEMENTS = [
    ("SELECT 1 FROM (SELECT 1 FROM s1.Orders) x JOIN nation n ON nation.id = {k}", "SELECT 1 FROM (SELECT 1 FROM d{k}.Orders) x JOIN d{k}.nation n ON nation.id = {k}"),
    ("SELECT {k} FROM region", None),
    ("SELECT a IS DISTINCT FROM nation FROM orders", "SELECT a IS DISTINCT FROM nation FROM d{k}.orders"),
    ("WITH nation AS (SELECT {k}) SELECT * FROM nation", None),
]


@check("d9_statements_for_dataset", "SELECT * FROM (SELECT o_orderkey, "
       + _by_order_key([want or "" for _, want in _DATASET_STATEMENTS], _KEY_JOIN) + " AS sql FROM orders) WHERE sql <> ''")
def statements_for_dataset(spark, sf_dir):
    """Known tables of a statement, and only those, move to a dataset; statements without any are left out."""
    spread(table(spark, sf_dir, "orders"), "o_orderkey").createOrReplaceTempView("orders")
    sql = _by_order_key([sql for sql, _ in _DATASET_STATEMENTS], _KEY_JOIN)
    texts = spark.sql(f"SELECT o_orderkey, concat('d', o_custkey) AS prefix, {sql} AS sql FROM orders")
    moved = md.statement_for_dataset(F.col("sql"), F.lit(_DATASET_DDL), F.col("prefix"))
    return texts.select("o_orderkey", present(moved).alias("sql"))


@check("d8_known_references", """
SELECT p_partkey, concat('part_', p_partkey, CASE WHEN p_partkey % 50 = p_size THEN concat('|LOOKUP_', p_size) ELSE '' END) AS names FROM part
""")
def known_references(spark, sf_dir):
    names = let(md.known_references(F.col("sql"), F.col("ddl")), lambda n: F.when(F.size(n) > 0, F.array_join(n, "|")))
    return statement_texts(spark, sf_dir).select("p_partkey", present(names).alias("names"))


@check("d9_qualified_tables", """
SELECT p_partkey, concat('SELECT b.x FROM shop.big_', p_partkey, ' b JOIN shop.Small ON big_', p_partkey, '.x = 1 WHERE Smaller = 2 AND  shop.Small=3') AS sql,
       concat('SELECT b.x FROM test', p_size, '_shop.big_', p_partkey, ' b JOIN test', p_size, '_shop.Small ON big_', p_partkey,
              '.x = 1 WHERE Smaller = 2 AND  test', p_size, '_shop.Small=3') AS test_sql FROM part
""".replace("AND  shop.Small=3", "AND shop.Small=3").replace("AND  test", "AND test"))
def qualified_tables(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    sql = F.concat(
        F.lit("SELECT b.x FROM big_"), key, F.lit(" b JOIN Small ON big_"), key, F.lit(".x = 1 WHERE Smaller = 2 AND Small=3")
    )
    names = F.array(F.concat(F.lit("big_"), key), F.lit("Small"))
    parts = spread(table(spark, sf_dir, "part"), "p_partkey")
    test = F.concat(F.lit("test"), F.col("p_size").cast("string"), F.lit("_shop"))
    return parts.select(
        "p_partkey",
        md.qualify_tables(sql, names, F.lit("shop")).alias("sql"),
        md.qualify_tables(sql, names, test).alias("test_sql"),
    )


@check("d10_clean_metadata", """
SELECT p_partkey, concat('CREATE TABLE t_', p_partkey, ' (', chr(10), '  id bigint, ', chr(10), '  name text', chr(10), ');') AS ddl FROM part
""")
def clean_metadata(spark, sf_dir):
    text = F.concat(
        F.lit(" CREATE TABLE t_"), F.col("p_partkey").cast("string"), F.lit(" (\n  id bigint, --key of "), "p_name",
        F.lit("\n  name text,\n);\nHere is a list of joinable columns:\nt.a can be joined with "), "p_type",
    )
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", md.clean_metadata(text).alias("ddl"))


@check("d11_quoted_words", """
SELECT p_partkey, concat('CREATE TABLE `transaction` (', chr(10), '  `order` int, /* order of ', p_name, ' */ "order" text, reorder int, /* x */ `order` date)') AS ddl FROM part
""")
def quoted_words(spark, sf_dir):
    text = F.concat(
        F.lit("CREATE TABLE Transaction (\n  order int, /* order of "), "p_name",
        F.lit(' */ "order" text, reorder int, /* x */ ORDER date)'),
    )
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(
        "p_partkey", rewrite.quote_words(text, rewrite.QUOTED_WORDS["sqlite"]).alias("ddl")
    )


@check("d12_rule_packs", """
SELECT p_partkey, concat('SELECT * FROM part WHERE p_name ILIKE ''', p_name, ''' AND p_type LIKE ''', p_type, '''') AS sql,
       concat('id_', p_partkey, ' SERIAL, n text ') AS ddl_start,
       concat('(a VARCHAR(255), b VARCHAR(', p_size, ')', ');', chr(10), 'CREATE TABLE x') AS mysql,
       concat('id INT IDENTITY(1,1), k', p_partkey) AS tsql, concat('id INTEGER PRIMARY KEY, k', p_partkey) AS sqlite,
       concat('id INT64, t DATETIME DEFAULT CAST(CURRENT_TIMESTAMP() AS DATETIME) NOT NULL, k', p_partkey) AS bigquery
FROM part
""")
def rule_packs(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    sql = F.concat(F.lit("SELECT * FROM part WHERE p_name ~* '"), "p_name", F.lit("' AND p_type ~ '"), "p_type", F.lit("'"))
    start = F.concat(F.lit("id_"), key, F.lit(" SERIAL PRIMARY KEY, n text UNIQUE"))
    mysql = F.concat(F.lit("(a VARCHAR, b VARCHAR("), F.col("p_size").cast("string"), F.lit("))\nCREATE TABLE x"))
    serial = F.concat(F.lit("id SERIAL, k"), key)
    stamp = F.concat(F.lit("id SERIALPRIMARY KEY, t DATETIME NOT NULL DEFAULT CURRENT_TIMESTAMP(), k"), key)
    ends = rewrite.DDL_END_RULES
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(
        "p_partkey",
        rewrite.rewrite(sql, rewrite.SQL_RULES).alias("sql"),
        rewrite.rewrite(start, rewrite.DDL_START_RULES).alias("ddl_start"),
        rewrite.rewrite(mysql, ends["mysql"]).alias("mysql"),
        rewrite.rewrite(serial, ends["tsql"]).alias("tsql"),
        rewrite.rewrite(serial, ends["sqlite"]).alias("sqlite"),
        rewrite.rewrite(stamp, ends["bigquery"]).alias("bigquery"),
    )


# Instruction texts by order key: a phrase with a number of its own and a plain end.
INSTRUCTION_SQL = """
SELECT o_orderkey, concat('Use ', replace(CASE o_orderkey % 12
  WHEN 0 THEN concat('DATE_TRUNC(~month~, CURRENT_DATE) - INTERVAL ~', n, ' months~')
  WHEN 1 THEN concat('DATE_TRUNC(~month~, CURRENT_DATE) - INTERVAL ~', n, ' day~')
  WHEN 2 THEN concat('DATE_TRUNC(~week~, CURRENT_DATE) - INTERVAL ~', n, ' weeks~ and DATE_TRUNC(~week~, CURRENT_DATE) - INTERVAL ~2 week~')
  WHEN 3 THEN concat('DATE_TRUNC(~day~, CURRENT_DATE) - INTERVAL ~', n, ' days~')
  WHEN 4 THEN 'DATE_TRUNC(~week~, CURRENT_DATE)'
  WHEN 5 THEN 'DATE_TRUNC(~month~, t1.date)=DATE_TRUNC(~quarter~, t2.date)'
  WHEN 6 THEN 'DATE_TRUNC(~day~, o.made_at)'
  WHEN 7 THEN 'DATE_TRUNC(~<interval>~, t1.date) = DATE_TRUNC(~<interval>~, t2.date)'
  WHEN 8 THEN concat('CURRENT_DATE - INTERVAL ~', n, ' days~ or CURRENT_DATE + INTERVAL ~1 day~')
  WHEN 9 THEN 'CURRENT_DATE'
  WHEN 10 THEN concat('name ILIKE ~', o_orderstatus, '%~ or ilike; epoch')
  ELSE concat('DATE_TRUNC(~week~, CURRENT_DATE) - INTERVAL ~', n, ' days~') END, '~', chr(39)), ' for priority ', o_orderpriority) AS text
FROM (SELECT *, o_custkey % 40 + 1 AS n FROM orders)
"""
_WANT = {
    "mysql": [
        "concat('DATE_SUB(DATE_FORMAT(CURDATE(), ~%Y-%m-01~), INTERVAL ', n, ' MONTH)')",
        "concat('DATE_SUB(DATE_FORMAT(CURDATE(), ~%Y-%m-01~), INTERVAL ', n, ' DAY)')",
        "concat('DATE_SUB(DATE_FORMAT(CURDATE(), ~%Y-%m-%d~), INTERVAL ', n * 7, ' DAY) and DATE_SUB(DATE_FORMAT(CURDATE(), ~%Y-%m-%d~), INTERVAL 14 DAY)')",
        "concat('DATE_SUB(CURDATE(), INTERVAL ', n, ' DAY)')",
        "'SUBDATE(CURDATE(), WEEKDAY(CURDATE()))'",
        "'DATE_FORMAT(t1.date, ~%Y-%m-01~) = DATE_FORMAT(t2.date, ~%Y-%m-%d~)'",
        "'DATE(o.made_at)'",
        "'DATE_FORMAT(t1.date, ~<interval>~) = DATE_FORMAT(t2.date, ~<interval>~)'",
        "concat('CURDATE() - INTERVAL ', n, ' DAY or CURDATE() + INTERVAL 1 DAY')",
        "'CURDATE()'",
        "concat('LOWER(name) LIKE LOWER(~%', o_orderstatus, '%%~) or LIKE; UNIX_TIMESTAMP')",
        "concat('SUBDATE(CURDATE(), WEEKDAY(CURDATE())) - INTERVAL ~', n, ' days~')",
    ],
    "sqlite": [
        "concat('DATE(~now~, ~start of month~, ~-', n, ' months~)')",
        "concat('DATE(~now~, ~start of month~, ~-', n, ' day~)')",
        "concat('DATE(~now~,  ~-~ || ((strftime(~%w~, ~now~) + 6) % 7) || ~ days~, ~-', n * 7, ' days~) and DATE(~now~,  ~-~ || ((strftime(~%w~, ~now~) + 6) % 7) || ~ days~, ~-14 days~)')",
        "concat('DATETIME(DATE(CURRENT_DA.E)) - INTERVAL ~', n, ' days~')",
        "'DATE(~now~,  ~-~ || ((strftime(~%w~, ~now~) + 6) % 7) || ~ days~)'",
        "'DATE_TRUNC(~month~, t1.date)=DATE_TRUNC(~quarter~, t2.date)'",
        "'DATETIME(DATE(o.made_at))'",
        "'DATE(t1.date, ~<interval>~) = DATE(t2.date, ~<interval>~)'",
        "concat('DATE(~now~, -~', n, ' days~) or DATE(~now~, +~1 day~)')",
        "'DATE(~now~)'",
        "concat('name ILIKE ~', o_orderstatus, '%~ or ilike; epoch')",
        "concat('DATE(~now~,  ~-~ || ((strftime(~%w~, ~now~) + 6) % 7) || ~ days~, ~-', n, ' days~)')",
    ],
    "tsql": [
        "concat('DATEADD(MONTH, -', n, ', DATEADD(MONTH, DATEDIFF(MONTH, 0, GETDATE()), 0))')",
        "concat('DATEADD(DAY, -', n, ', DATEADD(MONTH, DATEDIFF(MONTH, 0, GETDATE()), 0))')",
        "concat('DATEADD(WEEK, -', n, ', DATEADD(WEEK, DATEDIFF(WEEK, 0, GETDATE()), 0)) and DATEADD(WEEK, -2, DATEADD(WEEK, DATEDIFF(WEEK, 0, GETDATE()), 0))')",
        "concat('CONVERT(DATETIME, CONVERT(DATE, CURRENT_DA.E)) - INTERVAL ~', n, ' days~')",
        "'DATEADD(WEEK, DATEDIFF (WEEK, 0, GETDATE()), 0)'",
        "'DATE_TRUNC(~month~, t1.date)=DATE_TRUNC(~quarter~, t2.date)'",
        "'CONVERT(DATETIME, CONVERT(DATE, o.made_at))'",
        "'DATEADD(~<interval>~, DATEDIFF(~<interval>~, 0, t1.date), 0) = DATEADD(~<interval>~, DATEDIFF(~<interval>~, 0, t2.date), 0)'",
        "concat('DATEADD(DAY, -', n, ', CAST(GETDATE() AS DATE)) or DATEADD(DAY, +1, CAST(GETDATE() AS DATE))')",
        "'CAST(GETDATE() AS DATE)'",
        "concat('name ILIKE ~', o_orderstatus, '%~ or ilike; epoch')",
        "concat('DATEADD(DAY, -', n, ', DATEADD(WEEK, DATEDIFF(WEEK, 0, GETDATE()), 0))')",
    ],
}


def _instruction_check(dialect):
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(_WANT[dialect]))
    oracle = f"""
SELECT o_orderkey, concat('Use ', replace(CASE o_orderkey % 12 {cases} END, '~', chr(39)), ' for priority ', o_orderpriority) AS text
FROM (SELECT *, o_custkey % 40 + 1 AS n FROM orders)"""

    @check(f"d13_instructions_{dialect}", oracle)
    def run(spark, sf_dir):
        spread(table(spark, sf_dir, "orders"), "o_orderkey").createOrReplaceTempView("orders")
        texts = spark.sql(INSTRUCTION_SQL)
        return texts.select("o_orderkey", rewrite.rewrite_instructions(F.col("text"), dialect).alias("text"))

    return run


for _dialect in rewrite.INSTRUCTION_RULES:
    _instruction_check(_dialect)


_NAMES_SQL = """
SELECT c_custkey, c_name, CASE c_custkey % 4
  WHEN 0 THEN 'public.order_items,OrderInvoices,oi,regions2,Regions'
  WHEN 1 THEN 'as_set,any_new_data,and_yet,alpha'
  WHEN 2 THEN 'sbCustomer,sbCount,sbCity,s_c,x9y12'
  ELSE concat('users,UserTable,u_', c_custkey, ',ut') END AS names
FROM customer
"""
_ALIASES = """
CASE c_custkey % 4
  WHEN 0 THEN 'public.order_items=oi,OrderInvoices=ord,oi=o,regions2=r2,Regions=r'
  WHEN 1 THEN 'as_set=as_,any_new_data=an,and_yet=ay,alpha=a'
  WHEN 2 THEN 'sbCustomer=sc,sbCount=sb,sbCity=sbc,s_c=s_,x9y12=x2'
  ELSE concat('users=u,UserTable=ut,u_', c_custkey, '=u', substr(c_custkey::VARCHAR, 1, 1), CASE WHEN substr(c_custkey::VARCHAR, 1, 1) = '2' THEN ',ut=u3' ELSE ',ut=u2' END) END
"""


@check("d14_table_aliases", f"SELECT c_custkey, {_ALIASES} AS aliases FROM customer")
def table_aliases(spark, sf_dir):
    spread(table(spark, sf_dir, "customer"), "c_custkey").createOrReplaceTempView("customer")
    named = spark.sql(_NAMES_SQL)
    aliases = md.table_aliases(F.split("names", ","))
    return named.select(
        "c_custkey",
        F.array_join(F.transform(aliases, lambda a: F.concat(a["name"], F.lit("="), a["alias"])), ",").alias("aliases"),
    )


@check("d14_older_aliases", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'order_items=o,OrderInvoices=O,oi=oi,regions2=r,Regions=R'
  WHEN 1 THEN 'as_set=a,any_new_data=an,and_yet=ay,alpha=al' WHEN 2 THEN 'sbCustomer=s,sbCount=sb,sbCity=sbC,s_c=sc,x9y12=x'
  ELSE concat('users=u,UserTable=U,u_', c_custkey, '=u', substr(c_custkey::VARCHAR, 1, 1), ',ut=ut') END AS aliases FROM customer
""".replace("1 THEN 'as_set=a,any_new_data=an,", "1 THEN 'as_set=a,any_new_data=an,"))
def older_aliases(spark, sf_dir):
    spread(table(spark, sf_dir, "customer"), "c_custkey").createOrReplaceTempView("customer")
    named = spark.sql(_NAMES_SQL)
    aliases = md.older_table_aliases(F.split("names", ","))
    return named.select(
        "c_custkey",
        F.array_join(F.transform(aliases, lambda a: F.concat(a["name"], F.lit("="), a["alias"])), ",").alias("aliases"),
    )


@check("d15_alias_hints", f"""
WITH a AS (SELECT c_custkey, {_ALIASES} AS pairs FROM customer),
p AS (SELECT c_custkey, string_split(pairs, ',') AS l FROM a)
SELECT c_custkey, concat('Use the following table aliases when referencing tables in the query:', chr(10),
       array_to_string(list_transform(l, lambda x: concat('-- ', split_part(x, '=', 1), ' AS ', split_part(x, '=', 2), chr(10))), '')) AS hint
FROM p
""")
def alias_hints(spark, sf_dir):
    spread(table(spark, sf_dir, "customer"), "c_custkey").createOrReplaceTempView("customer")
    return spark.sql(_NAMES_SQL).select("c_custkey", md.alias_hint(F.split("names", ",")).alias("hint"))


_JOINS_SQL = """
SELECT concat('db', c_nationkey) AS db_name, c_custkey AS ord, concat('customer.', CASE c_custkey % 3 WHEN 0 THEN 'id' ELSE c_mktsegment END) AS left_col,
       concat('orders.', CASE c_custkey % 2 WHEN 0 THEN 'id' ELSE c_mktsegment END) AS right_col FROM customer
"""


@check("d16_join_hints", f"""
WITH j AS ({_JOINS_SQL}),
l AS (SELECT db_name, concat(left_col, ' can be joined with ', right_col) AS line, split_part(left_col, '.', 2) <> split_part(right_col, '.', 2) AS differs, min(ord) AS first_at
      FROM j GROUP BY ALL)
SELECT db_name, concat(chr(10), 'Here is a list of joinable columns:', chr(10), string_agg(line, chr(10) ORDER BY first_at)) AS join_str,
       coalesce(concat(chr(10), 'Here is a list of joinable columns with different names:', chr(10)) || string_agg(line, chr(10) ORDER BY first_at) FILTER (differs), '') AS pruned_join_str
FROM l GROUP BY db_name
""")
def join_hints(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return md.join_hints(spark.sql(_JOINS_SQL))


_TEMPLATES = {
    "text": "### Task\nAnswer `{user_question}` in {db_type}.\n{instructions}\nAgain: {user_question} {{as json}}\n{instruction_reflections}```sql\n",
    "chat": '[{"role": "system", "content": "Write {db_type}."}, {"role": "user", "content": "Q: {user_question}\\n{instructions}"}]',
}
_ASKED_SQL = """
SELECT o_orderkey, concat('How much is {db_type} order ', o_orderkey, '?') AS question,
       CASE WHEN o_orderkey % 2 = 0 THEN concat(chr(10), 'Follow the instructions below to generate the query:', chr(10), 'Use ', o_orderpriority, chr(10)) ELSE '' END AS instructions
FROM orders
"""


@check("d17_prompts", f"""
WITH q AS ({_ASKED_SQL})
SELECT o_orderkey, 'text' AS template, concat('### Task', chr(10), 'Answer `', question, '` in postgres.', chr(10), instructions, chr(10), 'Again: ', question,
       ' {{as json}}', chr(10), replace(instructions, 'Follow the instructions below', 'Additionally, I was asked to follow the instructions below'), chr(10), '```sql', chr(10)) AS prompt FROM q
UNION ALL
SELECT o_orderkey, 'chat', concat('system:Write postgres.|user:Q: ', question, chr(10), instructions) FROM q
""".replace("{{as json}}", "{as json}"))
def rendered_prompts(spark, sf_dir):
    spread(table(spark, sf_dir, "orders"), "o_orderkey").createOrReplaceTempView("orders")
    values = {
        "user_question": F.col("question"),
        "db_type": F.lit("postgres"),
        "instructions": F.col("instructions"),
        "instruction_reflections": prompts.reflections(F.col("instructions")),
    }
    rendered = prompts.render_prompts(spark.sql(_ASKED_SQL), _TEMPLATES, values)
    messages = F.transform(
        F.from_json("prompt", prompts.MESSAGES), lambda m: F.concat(m["role"], F.lit(":"), m["content"])
    )
    shown = F.when(F.col("template") == "chat", F.array_join(messages, "|")).otherwise(F.col("prompt"))
    return rendered.select("o_orderkey", "template", shown.alias("prompt"))


_TARGETS = ("postgres", "bigquery", "mysql", "sqlite", "tsql", "oracle")


@check("d18_dialect_dispatch", f"""
WITH d AS ({DDL_SQL})
SELECT dialect, CASE WHEN dialect = 'oracle' THEN 0 ELSE (SELECT count(*) FROM d) END AS n_texts,
       CASE WHEN dialect = 'oracle' THEN 'unsupported dialect oracle' ELSE '' END AS error,
       CASE WHEN dialect = 'postgres' THEN (SELECT count(*) FROM d) ELSE 0 END AS unchanged
FROM (VALUES ('postgres'), ('bigquery'), ('mysql'), ('sqlite'), ('tsql'), ('oracle')) v(dialect)
""")
def dialect_dispatch(spark, sf_dir):
    texts = ddl_texts(spark, sf_dir)
    converted, errors = [], []
    for dialect in _TARGETS:
        try:
            converted.append((dialect, rewrite.convert_ddl(F.col("ddl"), dialect, F.lit("shop"))))
        except ValueError as exc:
            errors.append((dialect, 0, str(exc), 0))
    listed = F.array(*[F.struct(F.lit(d).alias("dialect"), c.alias("text")) for d, c in converted])
    counted = (
        texts.select("ddl", F.explode(listed).alias("c"))
        .groupBy("c.dialect")
        .agg(
            F.count("c.text").alias("n_texts"),
            F.lit("").alias("error"),
            F.sum((F.col("c.text") == F.col("ddl")).cast("bigint")).alias("unchanged"),
        )
    )
    return counted.unionByName(
        spark.createDataFrame(errors, "dialect string, n_texts bigint, error string, unchanged bigint")
    )


def _ddl_want(prefix, types, created="CREATE TABLE ", schema_one="''", schema_two="''", words=("long", "order")):
    num, txt, vch, ts, integer = types
    long_word, order_word = words
    return f"""concat('{created}', {prefix}, {schema_one}, 'part_', p_partkey, ' (', chr(10), '  id {num}, /* key of ', p_name, ' */', chr(10),
 '  {long_word} {vch} ,', chr(10), '  size numeric(10,2), /* in mm, ', p_type, ' */', chr(10), '  made_at {ts}', chr(10), ');', chr(10),
 '{created}', {prefix}, {schema_two}, 'Lookup_', p_size, ' (', chr(10), '  {order_word} {integer},', chr(10), '  name {txt} /* plain */', chr(10), ');')"""


_BQ = ("INT64", "STRING", "STRING", "DATETIME", "INT64")
_MY = ("bigint", "text", "varchar", "DATETIME", "INT")
_LITE = ("INTEGER", "TEXT", "TEXT", "TIMESTAMP", "INTEGER")
_TS = ("bigint", "VARCHAR(MAX)", "varchar", "DATETIME2", "INT")
_TICK = ("`long`", "order")


@check("d19_whole_ddl", f"""
WITH d AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'alpha.' WHEN 1 THEN 'beta.' ELSE '' END AS s,
           CASE WHEN p_size % 2 = 0 THEN 'beta.' ELSE '' END AS s2 FROM part)
SELECT p_partkey, 'bigquery' AS dialect, {_ddl_want("'shop.'", _BQ, words=_TICK)} AS ddl, {_ddl_want("concat('test', p_partkey, '_shop.')", _BQ, words=_TICK)} AS test_ddl FROM d
UNION ALL SELECT p_partkey, 'mysql', {_ddl_want("'shop.'", _MY, words=_TICK)}, {_ddl_want("concat('test', p_partkey, '_shop.')", _MY, words=_TICK)} FROM d
UNION ALL SELECT p_partkey, 'sqlite', {_ddl_want("''", _LITE, words=('long', '`order`'))}, {_ddl_want("''", _LITE, words=('long', '`order`'))} FROM d
UNION ALL SELECT p_partkey, 'tsql', {_ddl_want("''", _TS, schema_one='s', schema_two='s2')}, {_ddl_want("''", _TS, schema_one='s', schema_two='s2')} FROM d
""")
def whole_ddl(spark, sf_dir):
    texts = ddl_texts(spark, sf_dir)
    listed = F.array(
        *[
            F.struct(F.lit(d).alias("dialect"), rewrite.translate_ddl(F.col("ddl"), d, F.lit("shop"), F.col("p_partkey")).alias("t"))
            for d in rewrite.DIALECTS
        ]
    )
    return texts.select("p_partkey", F.explode(listed).alias("x")).select(
        "p_partkey", "x.dialect", "x.t.ddl", "x.t.test_ddl"
    )
