"""Exact and subset matches by rule: every change of a result, on several results cut from the given tables.

A change turns a result into another one, and the rule says what a comparison of
the two must find. Each is judged pairwise and, all together, in the long form.
"""

from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators.capture import capture, unique_labels
from assayer.operators.pairwise import compare_frames
from assayer.operators.score import comparison_plan, result_heads, score_alternatives, score_pairs
from assayer.session import scratch, table

# Results with a unique first column, names in the order of the alphabet, a floating column, ties and nulls.
RESULTS = {
    "suppliers": ("supplier", "s_suppkey <= 6", ["s_suppkey AS key", "s_acctbal AS paid", "s_nationkey AS state"]),
    "segments": ("customer", "c_custkey BETWEEN 20 AND 31", ["c_custkey AS key", "c_acctbal AS paid", "c_mktsegment AS segment"]),
    "dates": ("orders", "o_orderkey < 9", ["o_orderkey AS key", "o_totalprice AS paid", "o_orderdate AS since", "CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus END AS status"]),
}


def renamed(rows, columns, into):
    return rows, [(new, kind) for new, (_, kind) in zip(into, columns, strict=True)]


def changed(rows, columns):
    """The first row gets the last value of another row that differs."""
    other = next(r[-1] for r in rows if r[-1] != rows[0][-1])
    return [(*rows[0][:-1], other), *rows[1:]], columns


def noisy(rows, columns, factor):
    """Floating columns times a factor."""
    floats = [i for i, (_, kind) in enumerate(columns) if kind == "double"]
    return [tuple(v * factor if i in floats else v for i, v in enumerate(r)) for r in rows], columns


# change: (new rows and columns, exact, subset). The gold side is the result itself.
CHANGES = {
    "nothing": (lambda r, c: (r, c), True, True),
    "rows turned around": (lambda r, c: (r[::-1], c), True, True),
    "columns turned around": (lambda r, c: ([x[::-1] for x in r], c[::-1]), True, True),
    "names in capitals": (lambda r, c: renamed(r, c, [n.upper() for n, _ in c]), True, True),
    "new names": (lambda r, c: renamed(r, c, [f"col{i}" for i in range(len(c))]), True, True),
    "new names and rows turned around": (lambda r, c: renamed(r[::-1], c, [f"col{i}" for i in range(len(c))]), True, True),
    "a column more": (lambda r, c: ([(*x, i) for i, x in enumerate(r)], [*c, ("zz", "int")]), False, True),
    "a column more in front, new names": (lambda r, c: ([(f"t{i}", *x) for i, x in enumerate(r)], [("aa", "string"), *[(f"col{i}", k) for i, (_, k) in enumerate(c)]]), False, True),
    "a column less": (lambda r, c: ([x[1:] for x in r], c[1:]), False, False),
    "a value changed": (changed, False, False),
    "a value lost": (lambda r, c: ([(*r[0][:1], None, *r[0][2:]), *r[1:]], c), False, False),
    "a row less": (lambda r, c: (r[1:], c), False, False),
    "no rows": (lambda r, c: ([], c), False, False),
    "first column as text": (lambda r, c: ([(str(x[0]), *x[1:]) for x in r], [(c[0][0], "string"), *c[1:]]), False, False),
    "first column as whole floats": (lambda r, c: ([(float(x[0]), *x[1:]) for x in r], [(c[0][0], "double"), *c[1:]]), True, True),
    "a little noise": (lambda r, c: noisy(r, c, 1 + 1e-10), False, True),
    "too much noise": (lambda r, c: noisy(r, c, 1 + 1e-3), False, False),
}
# The changes take turns on the results, in the long form one result further.
NAMES = list(RESULTS)
PAIRWISE = [(NAMES[i % len(NAMES)], change) for i, change in enumerate(CHANGES)]
LONG_FORM = [(NAMES[(i + 1) % len(NAMES)], change) for i, change in enumerate(CHANGES)]


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    """(rows, columns with their types) of every result, ordered by the first column."""
    out = {}
    for name, (source, where, columns) in RESULTS.items():
        frame = table(spark, sf_dir, source).where(where).selectExpr(*columns).orderBy("key")
        rows = [tuple(r) for r in frame.collect()]
        out[name] = rows, [(f.name, f.dataType.simpleString()) for f in frame.schema.fields]
    return out


def frame_of(spark, rows, columns, place=False) -> DataFrame:
    schema = ", ".join(f"`{n}` {k}" for n, k in columns)
    if place:
        return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{schema}, pos bigint")
    return spark.createDataFrame(rows, schema).coalesce(1)


def test_results_have_what_the_changes_need(results):
    for rows, columns in results.values():
        assert len(rows) > 3 and len({r[0] for r in rows}) == len(rows) and len(columns) > 1
        assert any(r[-1] != rows[0][-1] for r in rows) and rows[0][1] is not None


@pytest.mark.parametrize(("result", "change"), PAIRWISE)
def test_pairwise(spark, results, result, change):
    rows, columns = results[result]
    make, exact, subset = CHANGES[change]
    found = compare_frames(frame_of(spark, rows, columns, True), frame_of(spark, *make(rows, columns), True), "basic", "Which?", pos="pos").first()
    assert (found.exact, found.subset) == (exact, subset)


# Order matters: the gold statement sorts by the second column, in which there are ties, or by the first one downwards.
ORDERED = {
    "same order": (None, None, lambda r: r, True, True),
    "turned around": (None, None, lambda r: r[::-1], False, False),
    "both by the first column": ("ORDER BY {0}", "ORDER BY {0}", lambda r: r, True, True),
    "same direction said otherwise": ("ORDER BY {0} ASC", "ORDER BY {0}", lambda r: r, True, True),
}


@pytest.fixture(scope="module")
def long_form(spark, results):
    """All cases scored in one run: what is wanted, (exact, subset) and (exact, correct) by number."""
    captured, asked, wanted = [], [], []
    for result, change in LONG_FORM:
        make, exact, subset = CHANGES[change]
        wanted.append((results[result], make(*results[result]), "basic", None, None, exact, subset))
    for i, (gold, gen, turn, exact, subset) in enumerate(ORDERED.values()):
        rows, columns = results[NAMES[i % len(NAMES)]]
        sqls = [s and "SELECT * FROM t " + s.format(columns[0][0]) for s in (gold, gen)]
        wanted.append(((rows, columns), (turn(rows), columns), "order_by", *sqls, exact, subset))
    wanted.append((([], results["segments"][1]), ([], results["segments"][1]), "basic", None, None, True, False))
    wanted.append((([], results["segments"][1]), results["segments"], "basic", None, None, False, False))
    doubled = (results["segments"][0] * 2, results["segments"][1])
    wanted.append((doubled, results["segments"], "basic", None, None, True, False))
    for i, (gold, gen, category, gold_sql, gen_sql, *_) in enumerate(wanted):
        captured.append(capture(frame_of(spark, *gold), i, "gold", 0))
        captured.append(capture(frame_of(spark, *gen), i, "gen"))
        asked.append((i, category, "Which?", gold_sql, gen_sql))
    path = scratch(spark, "cases")
    reduce(DataFrame.unionByName, captured).write.parquet(path)
    rows = spark.read.parquet(path)
    questions = spark.createDataFrame(asked, "pair_id bigint, query_category string, question string, sql_gold string, sql_gen string")
    plan = comparison_plan(result_heads(rows), questions)
    both = {r.pair_id: (r.exact, r.subset) for r in score_alternatives(rows, plan, skip_exact=False).collect()}
    folded = {r.pair_id: (r.exact, r.correct) for r in score_pairs(rows, questions).collect()}
    return wanted, both, folded


def test_long_form(long_form):
    wanted, both, folded = long_form
    for number, (*_, exact, subset) in enumerate(wanted):
        assert both[number] == (exact, subset), number
        assert folded[number] == (exact, exact or subset), number


INFINITE, NAN = float("inf"), float("nan")


@pytest.mark.parametrize(
    ("gold", "gen", "equal"),
    [
        ([1.0, INFINITE], [1.0, 5.0], False),
        ([1.0, INFINITE], [1.0, -INFINITE], False),
        ([1.0, INFINITE], [1.0, INFINITE], True),
        ([-INFINITE, None], [-INFINITE, None], True),
        ([NAN, 1.0], [NAN, 1.0], True),
        ([None, 1.0], [INFINITE, 1.0], False),
    ],
)
def test_odd_numbers_in_both_entry_styles(spark, gold, gen, equal):
    columns = [("k", "int"), ("v", "double")]
    frames = [frame_of(spark, list(enumerate(side)), columns) for side in (gold, gen)]
    found = compare_frames(*frames).first()
    path = scratch(spark, "odd")
    capture(frames[0], 0, "gold", 0).unionByName(capture(frames[1], 0, "gen")).write.parquet(path)
    questions = spark.createDataFrame([(0, "basic", "Which?", "x", "y")], "pair_id bigint, query_category string, question string, sql_gold string, sql_gen string")
    scored = score_pairs(spark.read.parquet(path), questions).first()
    assert (found.exact, found.subset) == (equal, equal)
    assert (scored.exact, scored.correct) == (equal, equal)


def test_twin_columns_are_matched_greedily(spark):
    gold = frame_of(spark, [(7, 9), (9, 7)], [("a", "int"), ("b", "int")])
    gen = frame_of(spark, [(9, 7), (7, 9)], [("a", "int"), ("b", "int")])
    found = compare_frames(gold, gen).first()
    assert (found.exact, found.subset) == (True, True)


def test_large_whole_numbers_differ_by_one(spark):
    gold, gen = (spark.createDataFrame([(n,)], "a bigint") for n in (2**61 + 1, 2**61))
    found = compare_frames(gold, gen).first()
    assert (found.exact, found.subset) == (False, False)


def test_order_without_positions_is_refused(spark, results):
    frame = frame_of(spark, *results["suppliers"])
    with pytest.raises(ValueError):
        compare_frames(frame, frame, "order_by", "Sort them.")


def test_unique_labels():
    assert unique_labels(["x", "y", "x", "x"]) == ["x_0", "y", "x_2", "x_3"]


def test_dates_differ_from_timestamps(spark):
    gold = spark.sql("SELECT DATE '2021-07-08' AS d")
    gen = spark.sql("SELECT TIMESTAMP_NTZ '2021-07-08 00:00:00' AS d")
    found = compare_frames(gold, gen).first()
    assert (found.exact, found.subset) == (False, False)
