import random

import numpy as np
import pytest

from assayer.llm.components import components
from assayer.llm import jaccard_join
from assayer.llm.jaccard_join import Rule, linked_components, one_of_each_component, segment_keys


def sets(rows, width):
    out = []
    for i, text in rows:
        w = (text or "").encode()
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in w).split()
        out.append((i, frozenset(tuple(w[p : p + width]) for p in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
    return out


def plain(rows, percent, width):
    known = sets(rows, width)
    parent = {i: i for i, _ in known if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(known):
        for j, y in known[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((top(i), top(j)))
                parent[hi] = lo
    return sorted(((i, len(x), None if i is None else top(i) if x else i) for i, x in known), key=str)


def near_copies(seed, n=40, length=120):
    random.seed(seed)
    base = [f"w{random.randrange(300)}" for _ in range(length)]
    rows = []
    for i in range(n):
        text = list(base) if i % 3 else [f"v{random.randrange(300)}" for _ in range(random.randint(1, 150))]
        for _ in range(random.randint(0, 8)):
            text[random.randrange(len(text))] = f"n{random.randrange(100)}"
        rows.append((i, " ".join(text[: random.choice([len(text), len(text) - 5])])))
    return rows


@pytest.mark.parametrize(("percent", "width"), [(85, 4), (80, 5)])
@pytest.mark.parametrize("seed", range(2))
def test_against_all_pairs(docs, percent, width, seed):
    rows = near_copies(seed)
    got = linked_components(docs(rows).repartition(3), percent=percent, width=width).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, percent, width)


def test_cases(docs):
    long = " ".join(f"l{i}" for i in range(5000))
    rows = [(5, "A b c"), (9, "a B C"), (4, "a b"), (7, None), (8, ""), (6, " \n"), (None, "a b c"), (3, "same text of a row here"), (3, "same text of a row here"), (2, long), (1, long + " end"), (30, "same text of a row here"), (11, "one"), (12, "One")]
    got = linked_components(docs(rows), percent=85, width=4).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, 85, 4)


def test_rows_of_one_id_are_one_node(docs):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "q r s t u v"), (3, "q r s t u v"), (4, "other words of a text")]
    got = {r.doc_id: r.component_id for r in linked_components(docs(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_empty_table(docs):
    assert linked_components(docs([])).collect() == []


def test_rows_that_stay(docs):
    frame = docs([(2, "a b c d e f"), (1, "a b c d e f"), (3, "x y z"), (None, "a b c d e f"), (4, None)])
    kept = one_of_each_component(frame)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "None"]


@pytest.mark.parametrize("seed", range(4))
def test_sets_that_differ_as_much_as_allowed_share_a_segment(seed):
    """Any two sets that link have a key in common, also where all differences are spread out."""
    rng = np.random.default_rng(seed)
    rule = Rule(85, 4)
    for _ in range(150):
        a = int(rng.integers(1, 400))
        shared = rng.integers(0, 1 << 63, a, dtype=np.uint64)
        x, y = shared, shared
        while True:  # as many differences as the rule allows
            one = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
            more = (np.append(x, one), y) if rng.random() < 0.5 else (x, np.append(y, one))
            inside = len(shared)
            if 100 * inside < 85 * (len(more[0]) + len(more[1]) - inside):
                break
            x, y = more
        assert np.intersect1d(segment_keys(np.unique(x), rule), segment_keys(np.unique(y), rule)).size


@pytest.mark.parametrize(("percent", "width"), [(85, 4), (80, 5)])
def test_linked_sets_share_a_segment_that_neither_leaves_out(percent, width):
    """Whatever the bitmaps say of the keys, as long as those that both sets have are in the first."""
    rng = np.random.default_rng(percent)
    rule = Rule(percent, width)
    for _ in range(300):
        inside = int(rng.integers(1, 900))
        most = (100 - percent) * inside // percent
        left = int(rng.integers(0, most + 1)) if rng.random() < 0.5 else rng.choice([0, most])
        x, y = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (inside + left, most - left))
        x, y = np.unique(x), np.unique(np.append(x[:inside], y))
        everything = np.full(1 << 17, 255, np.uint8)
        shared_by = [everything, *(rng.integers(0, 256, 1 << 17, dtype=np.uint8) for _ in range(3))]
        own, theirs = (jaccard_join.rare_keys(s, rule, shared_by) for s in (x, y))
        assert np.intersect1d(own, theirs).size, (len(x), len(y))


def test_a_long_passage_that_many_texts_share_makes_no_pairs(docs, monkeypatch):
    compared = []

    def verified(rows, candidates, rule):
        compared.append(candidates.count())
        return plainly(rows, candidates, rule)

    plainly = jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", verified)
    passage = " ".join(f"p{i}" for i in range(1350))
    rows = [(i, passage + "".join(f" o{i}x{k}" for k in range(1650))) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " and some words more") for i in range(5)]
    got = {r.doc_id: r.component_id for r in linked_components(docs(rows)).collect()}
    assert got == {**{i: i for i in range(40)}, **{100 + i: i for i in range(5)}}
    assert sum(compared) <= 50  # 780 pairs share the passage


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 102), (101, 103)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100, 103: 100}


def test_ids_as_texts_and_clashing_names(spark):
    rows = [("1", "a b c d e f g h"), ("2", "a b c d e f g h"), ("30", "other words stand in this one")]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id string, text string, gone_id int, GONE_ID_ int")
    from assayer.llm.jaccard_join import one_of_each_component

    assert sorted(r.doc_id for r in one_of_each_component(frame).collect()) == ["1", "30"]


def test_pairs_meet_in_few_of_the_segments_they_share():
    """A key knows the keys in front of it; pairs that share one of those have met there."""
    rng = np.random.default_rng(3)
    rule, everything = Rule(80, 5), [np.full(1 << 17, 255, np.uint8)] * 5
    inside = rng.integers(0, 1 << 63, 2400, dtype=np.uint64)
    x, y = (np.unique(np.append(inside, rng.integers(0, 1 << 63, 450, dtype=np.uint64))) for _ in range(2))
    own, theirs = ({int(row[0]): set(map(int, row[1:])) - {0} for row in jaccard_join.ranked_keys(s, rule, everything)} for s in (x, y))
    shared = own.keys() & theirs.keys()
    met = [key for key in shared if not own[key] & theirs[key]]
    assert 1 <= len(met) < len(shared) / 4
    assert all(before in own for keys in own.values() for before in keys)


def test_first_links_are_not_looked_at_again(docs, monkeypatch):
    """The components of the first links are linked further, not the ids."""
    looked_at = []

    def counted(links):
        looked_at.append(links.where("a <> b").distinct().count())
        return components(links)

    monkeypatch.setattr(jaccard_join, "components", counted)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base[:i] + [f"n{i}"] + base[i + 1 :])) for i in range(40)]
    assert {r.component_id for r in linked_components(docs(rows)).collect()} == {0}
    assert looked_at[0] >= 39 and looked_at[1] < 5
