import hashlib
from fractions import Fraction

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from assayer.llm import mixture

SCHEMA = "doc_id long, text string, source string, size int, `pass` int, at string, draw string, number int"


def frame(spark, rows):
    return spark.createDataFrame([(i, text, source, 1, 2, "x", "y", 3) for i, text, source in rows], SCHEMA)


def brute_targets(sizes, weights=(1, 2, 3), most=3, budget=None):
    """Targets by resharing until none is above its limit; ``sizes`` in the order of the sources."""
    left = Fraction(sum(sizes) if budget is None else budget)
    open_, out = dict(enumerate(sizes)), {}
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        held = [i for i, s in open_.items() if left * weights[i % len(weights)] / total >= most * s]
        if not held:
            out |= {i: left * weights[i % len(weights)] / total for i in open_}
            break
        for i in held:
            out[i] = Fraction(most * open_.pop(i))
        left -= sum(out[i] for i in held)
    return out


def brute_taken(rows, most=3):
    """(doc_id, text, source) rows to sorted (doc_id, size, source_size, target, taken)."""
    sized = [(i, len((t or "").encode().split()), s, hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()) for i, t, s in rows]
    names = sorted({s for _, _, s, _ in sized}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(n for _, n, s, _ in sized if s == name) for name in names]
    goal, out = brute_targets(sizes), []
    for k, name in enumerate(names):
        queue = sorted((draw, i, n) for i, n, s, draw in sized if s == name) if None not in [r[0] for r in rows] else sorted(
            ((draw, -1 if i is None else i, n) for i, n, s, draw in sized if s == name)
        )
        quota = int(float(goal[k]) + 0.5)
        taken = [0] * len(queue)
        for _ in range(most):
            for at, (_, _, n) in enumerate(queue):
                taken[at] += min(n, quota)
                quota -= min(n, quota)
        out += [(i, n, sizes[k], round(float(goal[k]), 6), t) for (_, i, n), t in zip(queue, taken, strict=True)]
    return sorted(out)


def run(spark, rows):
    got = mixture.taken_words(mixture.mix(frame(spark, rows))).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got)


def near(got, want):
    """Equal but for the words that rounding of targets takes over the budget, at most half a word for each source."""
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert sum(abs(g[4] - w[4]) for g, w in zip(got, want, strict=True)) <= 3


def test_against_brute_force(spark):
    rows = [(i, "w " * (1 + i * 7 % 13), f"s{i % 5}") for i in range(60)]
    near(run(spark, rows), brute_taken(rows))


def test_small_sources_stop_at_three_passes_and_the_rest_is_shared_again(spark):
    rows = [(i, "w " * 10, "a") for i in range(100)] + [(200, "a b", "b"), (201, "c d e", "c"), (300, "x " * 40, None)]
    got = {r[0]: r for r in run(spark, rows)}
    assert got[200][3:] == (6.0, 6) and got[201][3:] == (9.0, 9) and got[300][3] == 120.0
    assert sum(r[4] for r in got.values()) == sum(r[1] for r in got.values())
    near(run(spark, rows), brute_taken(rows))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from([None, "", " \t", "a", "a b c", "é\x0bü x", "w " * 30]), st.sampled_from([None, "", "A", "b", "é", "😀"])), max_size=25))
def test_random_tables(spark, rows):
    got, want = run(spark, rows), brute_taken(rows)
    near(got, want)
    assert all(0 <= taken <= 3 * size for _, size, _, _, taken in got)


def test_odd_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, None), (2, "", "a"), (None, " ", "b")]) == [(-1, 0, 0, 0.0, 0), (1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    # a row that is repeated many times: every copy counts, none is taken more than three times
    got = run(spark, [(7, "a b c", "s")] * 40 + [(8, "d", "t")])
    assert sum(r[4] for r in got) == 121 and len(got) == 41 and got[-1] == (8, 1, 1, 3.0, 3)


def test_the_merged_queue(spark):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 3}") for i in range(90)]
    items = mixture.mix(frame(spark, rows)).items.orderBy("place").collect()
    assert [r.finish for r in items] == sorted(r.finish for r in items)
    place = 0
    for r in items:
        place += r.taken
        assert r.place == place
    total = sum(1 + i % 9 for i in range(90))
    assert place in (total, total - 1)
    # halfway through the mix every source has about half of its words
    half = {s: sum(r.taken for r in items if r.source == s and r.place <= total / 2) for s in ("s0", "s1", "s2")}
    whole = {s: sum(r.taken for r in items if r.source == s) for s in half}
    assert all(abs(half[s] - whole[s] / 2) <= 20 for s in half)


def test_a_budget_of_its_own_cuts_the_mix(spark):
    rows = [(i, "w " * 5, f"s{i % 2}") for i in range(40)]
    got = mixture.mix(frame(spark, rows), weights=(1, 1), budget=33)
    assert sum(r.taken for r in got.items.collect()) in (32, 33)
