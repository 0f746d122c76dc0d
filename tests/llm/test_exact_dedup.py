import hashlib
import random

import pytest
from pyspark.sql import functions as F

from assayer.llm.exact_dedup import exact_duplicates, keep_one_of_equals


def plain(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    out, done = [], set()
    for i, text in rows:
        ids = groups[text or ""]
        known = [x for x in ids if x is not None]
        keep = max(known) if known else None
        kept = i == keep and (text or "") not in done
        if kept:
            done.add(text or "")
        out.append((i, keep, len(ids), kept, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "a b"), (2, None), (3, ""), (4, "a b"), (5, "A b"), (5, "A b"), (None, "a b"), (None, "z"), (None, "z"), (6, "é" * 50_000), (7, "é" * 50_000), (8, "a b ")]


def test_cases(docs):
    got = sorted((tuple(r) for r in exact_duplicates(docs(ROWS)).collect()), key=str)
    assert got == plain(ROWS)


def test_empty_table(docs):
    assert exact_duplicates(docs([])).collect() == []


def test_hot_texts_are_salted_and_combined(docs):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 200}") for i in range(1500)]
    got = exact_duplicates(docs(rows).repartition(16), slices=4, salts=8)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_same_digest_other_text(docs):
    """With a digest that often collides, whole texts decide."""
    random.seed(1)
    rows = [(i, random.choice("abcdef") * random.randint(1, 3)) for i in range(600)]
    got = exact_duplicates(docs(rows).repartition(8), digest=lambda text: F.length(text).cast("string"), slices=2, salts=4)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()), key=str) == sorted((p[:4] for p in plain(rows)), key=str)


def test_rows_that_stay(docs):
    frame = docs(ROWS)
    kept = keep_one_of_equals(frame)
    assert kept.columns == frame.columns
    # A group without any id keeps one row as well.
    assert sorted((r.doc_id, (r.text or "")[:3]) for r in kept.where("doc_id is not null").collect()) == [(3, ""), (4, "a b"), (5, "A b"), (7, "ééé"), (8, "a b")]
    assert [(r.doc_id, r.text) for r in kept.where("doc_id is null").collect()] == [(None, "z")]


def test_no_python_in_the_plan(docs):
    plan = exact_duplicates(docs(ROWS))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("seed", range(3))
def test_random(docs, seed):
    random.seed(seed)
    rows = [(random.choice([None, *range(40)]), random.choice([None, "", "x", "y", "xx", "y "])) for _ in range(80)]
    got = exact_duplicates(docs(rows).repartition(5)).collect()
    # Which of repeated rows is the kept one doesn't matter.
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)
