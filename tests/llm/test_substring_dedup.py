import random

import numpy as np
import pytest

from assayer.llm import substring_dedup as s
from assayer.llm.wordhash import windows, words_of


def plain(rows):
    split = [(s.NO_ID if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in split:
        for p in range(len(w) - 49):
            key = tuple(w[p : p + 50])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        stays = [True] * len(w)
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < i:
                stays[p : p + 50] = [False] * 50
        kept = [x for x, y in zip(w, stays, strict=True) if y]
        out.append((None if i == s.NO_ID else i, len(w), len(w) - len(kept), b" ".join(kept).decode()))
    return sorted(out, key=str)


def made(seed, n):
    random.seed(seed)
    return [f"w{random.randrange(2000)}" for _ in range(n)]


def cases():
    a, b, c = made(1, 120), made(2, 60), made(3, 50)
    rows = [a, made(4, 30) + a[10:70] + made(5, 30), a[:49], a[:50], a[71:120], b + a[:80], made(6, 20) + b + made(7, 20) + b, c, c + c, made(8, 10) + c[1:], ["x"] * 200, ["x"] * 55, ["x"] * 49 + ["y"], a, a]
    out = [(i, " ".join(r)) for i, r in enumerate(rows)]
    return [*out, (100, None), (101, ""), (102, " \t\n"), (3, " ".join(a[:50])), (3, " ".join(made(9, 60))), (None, " ".join(a)), (None, " ".join(made(9, 60))), (103, " ".join(b).upper()), (104, " ".join(b))]


def test_cases(docs):
    rows = cases()
    assert sorted((tuple(r) for r in s.kept_texts(docs(rows).repartition(4)).collect()), key=str) == plain(rows)


@pytest.mark.parametrize("seed", range(3))
def test_random_overlaps(docs, seed):
    random.seed(seed)
    base = made(seed, 400)
    rows = []
    for i in range(60):
        text = []
        for _ in range(random.randint(0, 4)):
            at = random.randrange(350)
            text += random.choice([base[at : at + random.randint(20, 130)], made(random.randrange(10**6), 20)])
        rows.append((random.randrange(50), " ".join(text)))
    assert sorted((tuple(r) for r in s.kept_texts(docs(rows).repartition(3)).collect()), key=str) == plain(rows)


def test_nothing_repeats(docs):
    assert s.repeated_spans(docs([(1, " ".join(made(1, 90))), (2, None)])).collect() == []
    assert s.kept_texts(docs([])).collect() == []


def test_winnowing_meets_every_window():
    words = words_of([" ".join(made(1, 900)), " ".join(["x"] * 300), " ".join(made(2, 49)), " ".join(made(3, 50))])
    places = s.selected(words, windows(words.hashes, s.QUARTER))
    for start in np.flatnonzero(s._whole_windows(words, s.WIDTH)):
        assert ((places >= start) & (places + s.QUARTER <= start + s.WIDTH)).any()
