"""Behaviour the registered queries do not reach."""

import random
from functools import reduce
from itertools import combinations, islice

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import prompts, rewrite, statement
from assayer.functions.ordering import stated_order, wants_order
from assayer.operators import errors, expand, ordered, pairwise, score
from assayer.operators.capture import RESULT_ROWS, capture
from assayer.plans import execute
from assayer.session import scratch
from assayer.sources import questions as qs
from assayer.sources import results


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_brace_span(spark):
    spans = {"ab {c} d": (3, 5), "ab {c} {d}": (3, 5), "ab {c": (-1, -1), "ab c}": (-1, -1), "ab": (-1, -1)}
    for text, want in spans.items():
        assert tuple(one(spark, expand.brace_span(F.lit(text)))) == want


def test_expansion_keeps_cte_and_second_statement(spark):
    text = (
        "WITH r AS (SELECT {t.a,t.b}, t.c FROM t GROUP BY {}, t.c) SELECT *, RANK() OVER (ORDER BY c DESC) AS p FROM r;"
        "SELECT {x, y} FROM u GROUP BY {};"
    )
    got = one(spark, expand.acceptable_statements(F.lit(text)))
    assert got == [
        "WITH r AS (SELECT t.a, t.c FROM t GROUP BY t.a, t.c) SELECT *, RANK() OVER (ORDER BY c DESC) AS p FROM r",
        "WITH r AS (SELECT t.b, t.c FROM t GROUP BY t.b, t.c) SELECT *, RANK() OVER (ORDER BY c DESC) AS p FROM r",
        "WITH r AS (SELECT t.a, t.b, t.c FROM t GROUP BY t.a, t.b, t.c) SELECT *, RANK() OVER (ORDER BY c DESC) AS p FROM r",
        "SELECT x FROM u GROUP BY x",
        "SELECT  y FROM u GROUP BY  y",
        "SELECT x,  y FROM u GROUP BY x,  y",
    ]


def test_intent_words(spark):
    texts = {"Sort by name": True, "in ORDER": True, "sorted, ordered": False, "border": False, "arrange it": True}
    for text, want in texts.items():
        assert one(spark, wants_order(F.lit("basic"), F.lit(text))) is want
    assert one(spark, wants_order(F.lit("order_by"), F.lit("x"))) is True


def test_robust_order_reads_over_line_breaks(spark):
    sql = F.lit("SELECT a\nFROM t\nORDER BY\n  t.a ASC\nLIMIT 3")
    faithful, robust = one(spark, stated_order(sql)), one(spark, stated_order(sql, robust=True))
    assert (faithful.stated, faithful["keys"], faithful.descending) == (True, [], True)
    assert (robust.stated, robust["keys"], robust.descending) == (True, ["a", "3"], False)


def test_normal_form_by_key(spark):
    rows = [("Ann", 25, "Oslo", 0), ("Eve", 35, "Rome", 1), ("Bob", 30, "Bonn", 2)]
    frame = spark.createDataFrame(rows, "name string, age int, city string, pos bigint")
    up = pairwise.normalise(frame, "order_by", "Sort by name.", "SELECT * FROM t ORDER BY name ASC")
    assert up.columns == ["age", "city", "name", "pos"]
    assert [r.name for r in up.orderBy("pos").collect()] == ["Ann", "Bob", "Eve"]
    down = pairwise.normalise(frame, "order_by", "Arrange by name.", "SELECT * FROM t ORDER BY name DESC")
    assert [r.name for r in down.orderBy("pos").collect()] == ["Eve", "Bob", "Ann"]


def _fold(spark, gold, gen, err_at=None):
    parts = [capture(df, 0, "gold", i) for i, df in enumerate(gold)] + [capture(gen, 0, "gen")]
    if err_at is not None:
        parts.append(spark.createDataFrame([(0, err_at, "gold", None, [], [], None, "boom")], RESULT_ROWS))
    asked = spark.createDataFrame(
        [(0, "basic", "Which?", None, None)],
        "pair_id bigint, query_category string, question string, sql_gold string, sql_gen string",
    )
    return score.score_pairs(reduce(DataFrame.unionByName, parts), asked).first()


def test_alternatives_are_folded(spark):
    ids = spark.createDataFrame([(1,), (2,)], "id int")
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    both = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    gold = [ids, names, both]
    assert [_fold(spark, gold, g).exact_alt for g in gold] == [0, 1, 2]
    more = spark.createDataFrame([(2, 9), (1, 8)], "id int, age int")
    row = _fold(spark, gold, more)
    assert (row.exact, row.correct, row.exact_alt) == (False, True, None)


def test_only_earlier_errors_count(spark):
    ids = spark.createDataFrame([(1,), (2,)], "id int")
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    later = _fold(spark, [ids], ids, err_at=1)
    assert (later.exact, later.failed) == (True, False)
    parts = [names, ids]
    earlier = _fold(spark, parts, spark.createDataFrame([(5,)], "id int"), err_at=2)
    assert (earlier.correct, earlier.failed, earlier.error) == (False, True, "boom")


def test_broadcast_quirk_is_opt_in(spark):
    one_row = spark.createDataFrame([(7,)], "a int")
    three = spark.createDataFrame([(7, 1), (7, 2), (7, 3)], "a int, b int").select("a")
    rows = capture(one_row, 0, "gold", 0).unionByName(capture(three, 0, "gen"))
    rows = rows.unionByName(capture(one_row.limit(0), 1, "gold", 0)).unionByName(capture(one_row, 1, "gen"))
    asked = spark.createDataFrame(
        [(i, "basic", "Which?", None, None) for i in range(2)],
        "pair_id bigint, query_category string, question string, sql_gold string, sql_gen string",
    )
    plain = {r.pair_id: r.exact for r in score.score_pairs(rows, asked).collect()}
    quirk = {r.pair_id: r.exact for r in score.score_pairs(rows, asked, numpy_broadcast=True).collect()}
    assert plain == {0: True, 1: False}  # duplicates are dropped before pair 0 is compared
    assert quirk == {0: True, 1: True}


def test_prompt_values_are_not_searched_again(spark):
    filled = one(spark, prompts.fill("{a} {{x}} {b} {c}", {"a": F.lit("{b}"), "b": F.lit("B")}))
    assert filled == "{b} {x} B {c}"


@pytest.mark.parametrize("convert", [rewrite.rewrite_instructions, lambda t, d: rewrite.convert_ddl(t, d, t)])
def test_unknown_dialects_are_refused(spark, convert):
    with pytest.raises(ValueError):
        convert(F.lit("x"), "oracle")


def test_k_shot_needs_its_column(spark):
    with pytest.raises(ValueError):
        qs.with_optional_texts(spark.range(1), k_shot=True)


def test_files_pair_up():
    assert qs.paired(["q"], ["p1", "p2"], ["o1", "o2"]) == [("q", "p1", "o1"), ("q", "p2", "o2")]
    with pytest.raises(ValueError):
        qs.paired(["q"], ["p1", "p2"], ["o1", "o2", "o3"])


def test_scan_skips_comments(spark):
    folder = scratch(spark, "comments")
    spark.createDataFrame([("# a note",), ("a,b",), ("1,x",), ("# more",), ("2,y",)], "v string").coalesce(1).write.text(
        f"{folder}/run_c1.csv"
    )
    # The text writer names its parts .txt, so the folder is read with its own pattern.
    spark.createDataFrame([(3, "z")], "a int, c string").coalesce(1).write.option("header", True).csv(f"{folder}/run_c2.csv")
    rows = results.scan_results(spark, folder, {"a": "int"})
    assert {(r.a, r.c, r.model) for r in rows.collect()} == {(3, "z", "run_c2")}


def test_statement_errors_are_kept(spark, sf_dir):
    spark.range(3).createOrReplaceTempView("three")
    rows = [(0, "gen", None, "SELECT id FROM three"), (0, "gold", 0, "SELECT nope FROM three")]
    statements = spark.createDataFrame(rows, "pair_id bigint, side string, alt int, sql string").collect()
    captured = execute.run_statements(spark, statements)
    assert captured.filter("err IS NOT NULL").count() == 1
    assert sorted(r.pos for r in captured.filter("pos IS NOT NULL").collect()) == [0, 1, 2]


def test_recurring_rows_with_null_keys(spark):
    rows = [(1, "a", None), (2, "a", None), (3, "a", "q"), (4, None, "q"), (5, None, "q")]
    runs = spark.createDataFrame(rows, "id int, db_name string, question string")
    assert sorted(r.id for r in errors.recurring(runs, by=["id"]).collect()) == [1, 2, 4, 5]


def test_beyond_the_broadcast_limit_the_salted_join_takes_over(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BROADCAST_BYTES", 0)
    base = spark.createDataFrame([(1, 4), (2, 5), (3, 6)], "a int, b int")
    more = spark.createDataFrame([(6, 3, 0), (4, 1, 0), (5, 2, 0)], "y int, x int, z int")
    row = _fold(spark, [base], more)
    assert (row.exact, row.correct) == (False, True)


def listed(options):
    """All non-empty subsets, smaller ones first, then by position."""
    return [c for n in range(1, len(options) + 1) for c in combinations(options, n)]


@pytest.mark.parametrize("n", [1, 2, 5, 11])
def test_alternatives_in_order(spark, n):
    options = [f"c{i}" for i in range(n)]
    text = "SELECT {" + ",".join(options) + "} FROM t GROUP BY {}; SELECT 1;; SELECT {x}"
    want = [f"SELECT {', '.join(c)} FROM t GROUP BY {', '.join(c)}" for c in listed(options)] + ["SELECT 1", "SELECT x"]
    frame = spark.createDataFrame([(1, text), (2, None), (3, " ; "), (4, "")], "alt_of int, query string")
    rows = expand.expand_gold(frame).orderBy("alt_of", "alt").collect()
    assert [(r.alt_of, r.alt, r.sql) for r in rows] == [(1, i, s) for i, s in enumerate(want)]
    assert expand.expand_gold(frame, first=4).count() == min(4, len(want))
    assert expand.expand_gold(frame, first=0).isEmpty()
    assert one(spark, expand.acceptable_statements(F.lit(text))) == want


def test_seventy_options_are_not_listed_as_a_whole(spark):
    options = [f"c{i}" for i in range(70)]
    frame = spark.createDataFrame([("SELECT 0; SELECT {" + ",".join(options) + "} FROM t; SELECT 1",)], "query string")
    rows = expand.expand_gold(frame, first=3000).orderBy("alt").collect()
    triples = [c for c in islice(combinations(options, 3), 3000)]
    want = [*((o,) for o in options), *combinations(options, 2), *triples]
    assert [r.sql for r in rows] == (["SELECT 0"] + [f"SELECT {', '.join(c)} FROM t" for c in want])[:3000]


def test_features_that_fail_together(spark):
    rng = random.Random(3)
    rows = [(*(int(rng.random() < p) * rng.choice([1, 3]) for p in (0.5, 0.4, 0.3, 0.9, 0.0)), rng.choice([0, 0, 1, None])) for _ in range(400)]
    names = ["a", "b", "odd name", "d", "never"]
    frame = spark.createDataFrame(rows, ", ".join(f"`{n}` int" for n in names) + ", correct int")
    wrong, right = [[{n for n, v in zip(names, r) if v} for r in rows if r[-1] == label] for label in (0, 1)]
    want = {}
    for size in range(1, 6):
        for c in combinations(names, size):
            w, g = (sum(set(c) <= r for r in side) for side in (wrong, right))
            if w >= 10:
                want[c] = (w, g, w / len(wrong), w / (w + g) / (len(wrong) / (len(wrong) + len(right))))
    got = {tuple(r.features): (r.n_wrong, r.n_right, r.support, r.lift) for r in errors.failing_together(frame, drop=[], least=10).collect()}
    assert got.keys() == want.keys()
    assert all(got[c] == pytest.approx(want[c]) for c in want)
    assert max(len(r.features) for r in errors.failing_together(frame, drop=[], least=10, most=2).collect()) == 2
    assert errors.failing_together(frame.limit(0), drop=[]).isEmpty()
    assert errors.failing_together(frame.where("correct = 1"), drop=[]).isEmpty()


def shape_of(spark, sql):
    return one(spark, statement.shape(F.lit(sql)))


def test_shape_of_statements(spark):
    same = ["SELECT a FROM t WHERE b = 'x' AND c > 17", "SELECT a\n FROM t -- it's one\nWHERE b = 'it''s' AND c > 9", "SELECT a FROM t WHERE b  =  '' /* = 'y' */ AND c > 0 "]
    assert len({shape_of(spark, s) for s in same}) == 1
    # What decides the analysis stays: ordinals, limits, names, formats, named arguments, wide numbers, marks that touch.
    apart = [
        "SELECT a FROM t WHERE b = 'x'", "SELECT a FROM t WHERE b = 1", "SELECT a FROM t WHERE b = 1.5", "SELECT a FROM t WHERE b = 12345678901",
        "SELECT a FROM t WHERE b = 'x' ORDER BY 1", "SELECT a FROM t WHERE b = 'x' ORDER BY 9", "SELECT a FROM t WHERE b = 'x' LIMIT 1",
        "SELECT 'x = ', a, 'b' FROM t", "SELECT 'x = ', z, 'b' FROM t", "SELECT f(b => 'x') FROM t", "SELECT f(b => 'y') FROM t",
        "SELECT a FROM t WHERE b >= 1", "SELECT a FROM t WHERE b > = 1", "SELECT a FROM t WHERE b = \"x\"", "SELECT a FROM t WHERE b = 'x\\'",
    ]
    assert len({shape_of(spark, s) for s in apart}) == len(apart)


def test_one_analysis_for_each_shape(spark, monkeypatch):
    asked = []
    check = execute.check_analysis
    monkeypatch.setattr(execute, "check_analysis", lambda session, sql: asked.append(sql) or check(session, sql))
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("SELECT a FROM t WHERE a > "), F.col("id"))).when(
        F.col("id") % 3 == 1, F.concat(F.lit("SELECT z FROM t WHERE b = 'n"), F.col("id"), F.lit("'"))
    ).when(F.col("id") % 9 == 2, F.lit(None).cast("string")).otherwise("SELEC a")
    frame = spark.range(3000).select("id", text.alias("sql")).unionByName(spark.range(5).select(F.lit(None).cast("bigint").alias("id"), F.lit("SELEC a").alias("sql")))
    ddl = "CREATE TABLE t (\n  a bigint, --a number\n  b string --a name\n);"
    found = execute.validate_sql(spark, frame, ddl=ddl)
    assert sorted(found.columns) == ["err", "id", "valid"] and found.count() == 3005
    counted = {(r.valid, r.err): r["count"] for r in found.groupBy("valid", "err").count().collect()}
    assert counted == {(True, ""): 1000, (False, "UNRESOLVED_COLUMN.WITH_SUGGESTION"): 1000, (False, "PARSE_SYNTAX_ERROR"): 671, (False, "PARSE_EMPTY_STATEMENT"): 334}
    assert len(asked) == 4
    assert execute.validate_sql(spark, frame.limit(0), ddl=ddl).isEmpty()


def test_equal_statements_run_once(spark, monkeypatch):
    spark.range(4).createOrReplaceTempView("four")
    asked = []
    check = execute.check_statement
    monkeypatch.setattr(execute, "check_statement", lambda session, sql, seconds: asked.append(sql) or check(session, sql, seconds))
    text = F.concat(F.lit("SELECT id FROM four WHERE id >= "), F.col("id") % 5)
    found = execute.validate_sql(spark, spark.range(100).select("id", text.alias("sql"))).collect()
    assert len(asked) == 5 and {r.id for r in found if not r.valid} == {i for i in range(100) if i % 5 == 4}
