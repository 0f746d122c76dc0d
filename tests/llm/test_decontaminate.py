import itertools
import random

import numpy as np
import pytest

from assayer.llm import decontaminate as d


def words(seed, n, size=5000):
    random.seed(seed)
    return [f"w{random.randrange(size)}" for _ in range(n)]


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id long, text string, words string, mask int")


@pytest.mark.parametrize(("length", "changed"), [(13, 2), (12, 1), (9, 1), (7, 1), (6, 0), (5, 0)])
def test_masks_are_lossless(length, changed):
    assert d.allowed(length) == changed
    masks = [[i for i, c in enumerate(m) if c == "1"] for m in d.masks_for(length)]
    spans = [len(m) for m in d.masks_for(length)]
    for bad in itertools.combinations(range(length), changed):
        assert any(all(o + i not in bad for i in m) for m, span in zip(masks, spans, strict=True) for o in range(length - span + 1))


def plain(docs, bench):
    found = set()
    for i, text in docs:
        a = ["".join(c.lower() if c.isascii() else c for c in w) for w in d_words(text)]
        for j, item in bench:
            b = d_words(item)
            if len(b) < d.SHORTEST:
                continue
            width = min(d.WINDOW, len(b))
            if any(sum(x == y for x, y in zip(a[p : p + width], b[q : q + width], strict=True)) >= width - d.allowed(width) for p in range(len(a) - width + 1) for q in range(len(b) - width + 1)):
                found.add((i, j))
    return found


def d_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if ord(c) >= 128 or c.isalnum():
            word += c.lower() if ord(c) < 128 else c
        elif word:
            out.append(word)
            word = ""
    return out


def changed(ws, places):
    return [f"new{p}" if p in places else w for p, w in enumerate(ws)]


def test_against_brute_force(spark, docs):
    bench = [(1, " ".join(words(1, 40))), (2, " ".join(words(2, 13))), (3, " ".join(words(3, 9))), (4, " ".join(words(4, 5))), (5, "too short item"), (6, None), (7, ""), (8, " ".join(words(1, 40)))]
    b1, b2, b3, b4 = (t.split() for _, t in bench[:4])
    texts = [
        words(10, 100) + b1 + words(11, 50), words(12, 30) + changed(b1, {0, 6, 12, 20, 21, 30}), changed(b1, {3, 9, 15, 21, 27, 33, 39}), changed(b1, {2, 6, 10, 14, 18, 22, 26, 30, 34, 38}),
        b2, changed(b2, {0, 12}), changed(b2, {0, 5, 12}), b2[:12], words(13, 9) + changed(b3, {4}) + words(14, 3), changed(b3, {2, 6}), b4, changed(b4, {1}), words(15, 3000),
    ]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(50, None), (51, ""), (52, "x"), (60, ", ".join(b1).upper()), (0, rows0 := " ".join(texts[0]))]
    got = {(r.doc_id, r.item_id) for r in d.contaminations(docs(rows), items(spark, bench)).collect()}
    assert rows0 and got == plain(rows, bench)
    assert {(0, 1), (1, 1), (60, 1), (0, 8)} <= got


def test_empty_sides(spark, docs):
    some = docs([(1, " ".join(words(1, 30)))])
    assert d.contaminations(some, items(spark, [])).collect() == []
    assert d.contaminations(docs([]), items(spark, [(1, " ".join(words(1, 30)))])).collect() == []


def test_rows_that_stay(spark, docs):
    bench = " ".join(words(1, 30))
    frame = docs([(1, f"so {bench} and"), (2, "clean"), (None, "clean too"), (3, None)])
    kept = d.without_contaminated(frame, items(spark, [(9, bench)]))
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "None"]


def test_overlap_reports_the_best_window():
    item = np.arange(20, dtype=np.int64)
    text = np.concatenate((np.full(5, 99), item, np.full(5, 98)))
    assert d.overlap(item, 3, text, 8, 7) == (13, 5, 21)


def test_long_items_carry_few_words(spark, docs):
    """Windows at the beginning, inside and at the end of a long item, with two words changed."""
    long = words(11, 1500, 10**6)
    seeds = d.seeds_of(items(spark, [(1, " ".join(long))]), "item_id", "text")
    assert max(len(r.words) for r in seeds.collect()) < 2 * d.WINDOW
    cuts = [long[0:13], long[700:713], long[1487:1500]]
    for cut in cuts:
        cut[3] = cut[9] = "other"
    rows = [(i, " ".join(["before", *cut, "behind"])) for i, cut in enumerate(cuts)] + [(9, " ".join([*long[700:705], "x", "y", "z", *long[708:713]]))]
    found = d.contaminations(docs(rows), items(spark, [(1, " ".join(long))])).collect()
    assert {(r.doc_id, r.equal_words, r.first_word, r.end_word) for r in found} == {(i, 11, 1, 14) for i in range(3)}
