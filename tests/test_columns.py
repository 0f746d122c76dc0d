"""Pairing columns of wide results."""

import random
import re

from pyspark.sql import functions as F

from assayer.operators import score
from assayer.session import materialise


def profiles_of(spark, gold, gen):
    """Profiles of two results given as lists of columns (tag, values) of equal length."""
    def rows(columns, side):
        cells = [
            [{"kind": "#", "num": float(v), "txt": None} if v is not None else {"kind": "~", "num": None, "txt": None} for v in values] for _, values in columns
        ]
        return [(1, 0, side, at, [column[at] for column in cells]) for at in range(len(columns[0][1]))]

    schema = "pair_id bigint, alt int, side string, pos bigint, vals array<struct<kind:string,num:double,txt:string>>"
    table = spark.createDataFrame([*rows(gold, "gold"), *rows(gen, "gen")], schema)
    plan = spark.createDataFrame([(1, 0, [t for t, _ in gold], [t for t, _ in gen])], "pair_id bigint, alt int, gold_tags array<string>, gen_tags array<string>")
    return materialise(score.column_profiles(table, plan))


def found(candidates):
    return {(r.g_col, r.n_col): r.sure for r in candidates.collect()}


def test_wide_results_are_not_paired_column_by_column(spark):
    draw = random.Random(1)
    ints = [("n", [draw.randrange(10**6) for _ in range(6)]) for _ in range(250)]
    floats = [("f", [draw.uniform(-1, 1) * 10.0 ** draw.randrange(-6, 9) for _ in range(6)]) for _ in range(250)]
    gold, gen = ints + floats, [("f", [v * (1 + 1e-7) for v in values]) for _, values in floats[::-1]] + ints[::-1]
    candidates = score.column_candidates(profiles_of(spark, gold, gen))
    plan = candidates._jdf.queryExecution().optimizedPlan().toString()
    joins = re.findall(r"Join Inner, \(?(.*)", plan)
    assert len(joins) >= 3 and all("g_n#" in join or "g_missing#" in join for join in joins)
    want = {(i, 499 - i): True for i in range(250)} | {(250 + i, 249 - i): False for i in range(250)}
    got = found(candidates)
    assert want.items() <= got.items() and len(got) <= 510


def test_equal_columns_give_one_partner_each_unless_one_is_floating(spark):
    one, two = [1, 2, 3], [4, 5, 6]
    got = found(score.column_candidates(profiles_of(spark, [("n", one)] * 20 + [("n", two)] * 2, [("n", two)] * 2 + [("n", one)] * 30)))
    assert got == {(i, i + 2): True for i in range(20)} | {(20, 0): True, (21, 1): True}
    mixed = found(score.column_candidates(profiles_of(spark, [("n", one), ("n", one)], [("f", one), ("n", one)])))
    assert mixed == {(i, j): True for i in range(2) for j in range(2)}
    taken = score.assign_columns(
        score.column_candidates(profiles_of(spark, [("n", one), ("n", one)], [("f", one), ("n", one)])).drop("sure")
    ).first()
    assert taken.taken == [0, 1]


def test_bands_miss_nothing(spark):
    draw = random.Random(4)
    numbers = [0.0, 1e-8, 1e-3, 5.0, -5.0, 1e300, *(draw.uniform(-1, 1) * 10.0 ** draw.randrange(-9, 12) for _ in range(300))]
    near = [(a, a + s * (1e-8 + 1e-5 * abs(a)) * draw.random()) for a in numbers for s in (1, -1)]
    frame = spark.createDataFrame(near, "a double, b double")
    apart = frame.filter(F.abs(score._band(F.col("a")) - score._band(F.col("b"))) > 1)
    assert apart.count() == 0


def test_no_values_and_endless_ones(spark):
    gold = [("f", [None, None]), ("f", [float("inf"), 1.0]), ("f", [1.0, 2.0])]
    gen = [("f", [1.0, 2.00000001]), ("f", [None, None]), ("f", [float("inf"), 1.00000001])]
    got = found(score.column_candidates(profiles_of(spark, gold, gen)))
    assert got == {(0, 1): True, (1, 2): False, (2, 0): False}
