"""Ordered work on groups, one of them holding most rows, against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from assayer.operators.ordered import attach, copied, heavy_keys, lowest_running_sum, ranked, running_totals, spread_join


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(rng.choice(["hot"] * 8 + ["b", "c"]), rng.randrange(10_000), rng.randrange(-5, 6), i) for i in range(4000)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, k int, d int, id int").repartition(5)


def by_group(rows):
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[3])):
        groups[r[0]].append(r)
    return groups


def test_ranked(frame, rows):
    want = {r[3]: i for members in by_group(rows).values() for i, r in enumerate(members, 1)}
    got = {r.id: r["rank"] for r in ranked(frame, ["g"], ["k", "id"]).collect()}
    assert got == want


def test_ranked_without_group(frame, rows):
    want = {r[3]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[3])), 1)}
    assert {r.id: r["rank"] for r in ranked(frame, [], ["k", "id"]).collect()} == want


def test_running_totals(frame, rows):
    want = {}
    for members in by_group(rows).values():
        total = 0
        for r in members:
            total += r[2]
            want[r[3]] = total
    got = running_totals(frame, ["g"], ["k", "id"], {"total": F.col("d")})
    assert {r.id: r.total for r in got.collect()} == want


def test_lowest_running_sum(frame, rows):
    want = {}
    for g, members in by_group(rows).items():
        total, low = 0, None
        for r in members:
            total += r[2]
            low = total if low is None else min(low, total)
        want[g] = low
    got = lowest_running_sum(frame, ["g"], ["k", "id"], "d")
    assert {r.g: r.lowest for r in got.collect()} == want


@pytest.mark.parametrize("join", [spread_join, attach])
def test_joins_keep_all_rows(spark, frame, rows, join):
    names = spark.createDataFrame([("hot", 1), ("b", 2)], "g string, n int")
    assert join(frame, names, ["g"], by=["id"]).count() == sum(r[0] != "c" for r in rows)
    assert join(frame, names, ["g"], by=["id"], how="left").count() == len(rows)
    assert join(frame, names, ["g"], by=["id"], how="left_semi").count() == sum(r[0] != "c" for r in rows)


def test_salted_join_does_not_fix_a_later_grouping(frame, spark):
    names = spark.createDataFrame([("hot", 1), ("b", 2)], "g string, n int").hint("merge")
    grouped = spread_join(frame, names, ["g"], by=["id"]).groupBy("g", "k").count()
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    # One exchange per join side and one for the grouping.
    assert plan.count("Exchange hashpartitioning") >= 3


def test_only_heavy_keys_are_copied(spark):
    """A key with a third of the rows, one just above the limit, and many that occur once or twice."""
    n = 300_000
    key = F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 500 == 1, -2).otherwise(F.col("id") % 190_000)
    big = spark.range(n).withColumn("k", key)
    small = big.select("k").distinct().withColumn("name", F.concat(F.lit("n"), F.col("k").cast("string")))
    heavy = heavy_keys(big, ["k"])
    named = {r["k"]: r["_salts"] for r in small.join(heavy, F.xxhash64("k") == F.col("_hash")).collect()}
    assert set(named) == {-1, -2} and named[-1] > named[-2] >= 2
    copies = copied(small, ["k"], heavy).groupBy("k").count().where("count > 1")
    assert {r["k"]: r["count"] for r in copies.collect()} == named
    joined = spread_join(big, small, ["k"], by=["id"])
    assert joined.count() == n and joined.where("name <> concat('n', k)").isEmpty()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_spread_join_of_nulls_and_empty_sides(spark, how):
    big = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("b", 4)], "k string, id int")
    small = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    want = sorted(map(str, big.join(small, "k", how).collect()))
    assert sorted(map(str, spread_join(big, small, ["k"], by=["id"], how=how).collect())) == want
    none = big.limit(0)
    assert spread_join(none, small, ["k"], by=["id"], how=how).isEmpty()
