"""Random results, changed in known ways, against a brute-force comparison."""

import math
import random
from functools import reduce

import pytest
from pyspark.sql import DataFrame

from assayer.operators.capture import capture
from assayer.operators.score import comparison_plan, result_heads, score_alternatives
from assayer.session import scratch

SCHEMA = "k int, v double, s string"


def close(a, b):
    if a is None or b is None:
        return a is b
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-5, abs_tol=1e-8)
    return a == b


def order(row):
    return [(v is None, "" if v is None else v) for v in row]


def columns_close(a, b):
    rank = lambda v: (v is None, 0 if v is None else v)
    try:
        return len(a) == len(b) and all(close(x, y) for x, y in zip(sorted(a, key=rank), sorted(b, key=rank)))
    except TypeError:
        return False


def brute(gold, gold_names, gen, gen_names):
    """(exact, subset) without ordering intent."""

    def normal(rows, names):
        at = sorted(range(len(names)), key=lambda i: names[i])
        return sorted({tuple(r[i] for i in at) for r in rows}, key=order)

    # A missing number differs from itself place by place, a missing text does not.
    exact = len(gold_names) == len(gen_names) and (
        (len(gold) == len(gen) and all(r[1] is not None and r == s for r, s in zip(gold, gen)))
        or normal(gold, gold_names) == normal(gen, gen_names)
    )
    taken = []
    for i in range(len(gold_names)):
        hit = [
            j for j in range(len(gen_names))
            if j not in taken and columns_close([r[i] for r in gold], [r[j] for r in gen])
        ]
        if not hit:
            return exact, False
        taken.append(hit[0])
    if not gold:
        return exact, False
    a, b = normal(gold, gold_names), normal([tuple(r[j] for j in taken) for r in gen], gold_names)
    return exact, len(a) == len(b) and all(close(x, y) for r, s in zip(a, b) for x, y in zip(r, s))


def make(rng):
    rows = [
        (rng.randrange(6), rng.choice([0.0, 1.5, 2.25, 1e-9, 1e7, None]), rng.choice(["x", "y", None]))
        for _ in range(rng.randrange(1, 9))
    ]
    gen, names = list(rows), ["k", "v", "s"]
    for change in rng.sample(["shuffle", "noise", "far", "drop", "cell", "extra", "rename", "repeat", "swap"], 2):
        if change == "shuffle":
            rng.shuffle(gen)
        elif change == "noise":
            gen = [(*r[:1], None if r[1] is None else r[1] * (1 + 1e-7), *r[2:]) for r in gen]
        elif change == "far":
            gen = [(*r[:1], None if r[1] is None else r[1] * (1 + 3e-5), *r[2:]) for r in gen]
        elif change == "drop":
            gen = gen[1:]
        elif change == "cell":
            i = rng.randrange(len(gen)) if gen else None
            gen = [(r[0] + 1, *r[1:]) if j == i else r for j, r in enumerate(gen)]
        elif change == "extra":
            gen, names = [(*r, j) for j, r in enumerate(gen)], [*names, "z"]
        elif change == "rename":
            names = ["s2", "k2", "v2", *names[3:]]
        elif change == "repeat":
            gen = gen + gen[:1]
    return rows, gen, names


@pytest.fixture(scope="module")
def outcome(spark):
    rng = random.Random(23)
    cases = [make(rng) for _ in range(32)]
    captured = []
    for i, (gold, gen, names) in enumerate(cases):
        kinds = ["int", "double", "string", "int"]
        schema = ", ".join(f"{n} {t}" for n, t in zip(names, kinds))
        captured.append(capture(spark.createDataFrame(gold, SCHEMA).coalesce(1), i, "gold", 0))
        captured.append(capture(spark.createDataFrame(gen, schema).coalesce(1), i, "gen"))
    path = scratch(spark, "random")
    for part in range(0, len(captured), 24):
        reduce(DataFrame.unionByName, captured[part : part + 24]).write.mode("append").parquet(path)
    rows = spark.read.parquet(path)
    questions = spark.createDataFrame(
        [(i, "basic", "Which?", None, None) for i in range(len(cases))],
        "pair_id bigint, query_category string, question string, sql_gold string, sql_gen string",
    )
    plan = comparison_plan(result_heads(rows), questions)
    got = {r.pair_id: (r.exact, r.subset) for r in score_alternatives(rows, plan, skip_exact=False).collect()}
    return cases, got


def test_random_results(outcome):
    cases, got = outcome
    wrong = {}
    for i, (gold, gen, names) in enumerate(cases):
        want = brute(gold, ["k", "v", "s"], gen, names)
        if got[i] != want:
            wrong[i] = (got[i], want, gold, gen, names)
    assert not wrong
    assert len(set(got.values())) >= 3
