import random
import re
from collections import Counter

from assayer.llm import collocations

SCHEMA = "doc_id long, text string, lang string, a long, words string, phrase int, covered string, n int, `rank` int"


def frame(spark, rows):
    return spark.createDataFrame([(i, text, lang, 5, "x", 1, "y", 2, 3) for i, (text, lang) in enumerate(rows)], SCHEMA)


def brute(rows, longest=3, least=10, share=50, first=2000):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", plain):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    covered = set()
    for (lang, words), a in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                if 100 * a >= share * counts[lang, words[i : i + k]]:
                    covered.add((lang, words[i : i + k]))
    out = {}
    for (lang, words), a in candidates.items():
        if (lang, words) not in covered:
            score, _, l, r = min((10**6 * a * a // (counts[lang, words[:i]] * counts[lang, words[i:]]), i, counts[lang, words[:i]], counts[lang, words[i:]]) for i in range(1, len(words)))
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return sorted(
        (lang, rank, p.decode(), -a, l, r, totals[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:first], 1)
    )


def run(spark, rows, **more):
    return sorted(tuple(r) for r in collocations.collocations(frame(spark, rows), **more).collect())


def some_rows(seed, n):
    draw = random.Random(seed)
    words = ["New", "york", "the", "of", "É", "a\x01", "x\x00y", "b", "c", "😀", "of'", "no-one"]
    gaps = [*[" "] * 20, "  ", "\t", ", ", ".", "\n", " \x0b", "!? "]
    return [
        ("".join(draw.choice(words) + draw.choice(gaps) for _ in range(draw.randrange(80))) if draw.random() < 0.9 else draw.choice(["", None, " .. "]), draw.choice(["en", "en", "de", None, "und", ""]))
        for _ in range(n)
    ]


def test_against_brute_force(spark):
    rows = some_rows(1, 250)
    want = brute(rows)
    assert len(want) > 50 and run(spark, rows) == want


def test_longer_phrases_ties_and_a_short_list(spark):
    rows = some_rows(2, 120) + [("one two three four five", "en")] * 7
    assert run(spark, rows, longest=5, least=3, share=80, first=40) == brute(rows, 5, 3, 80, 40)


def test_one_word_before_all_others(spark):
    # a word that begins and ends most phrases lies in many slices
    rows = [(f"the w{i % 40} the v{i % 9}", "en") for i in range(600)]
    assert run(spark, rows) == brute(rows)


def test_slices_cut_anywhere(spark):
    rows = some_rows(3, 150)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert run(spark, rows, least=2) == brute(rows, least=2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_odd_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None), ("", "en"), (" ,. \n", "de"), ("alone", "fr")]) == []
    assert run(spark, [("a b", None)] * 10 + [("A\tB", "und")]) == [("und", 1, "a b", 11, 11, 11, 22, 1_000_000)]


def test_blocks_end_where_pieces_end(monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 16)
    texts = ["one two three four five six seven", "a.b.c.d.e.f.g.h.i", "", "x" * 50 + " y"]
    blocks = list(collocations.blocks_of(texts))
    assert b"".join(blocks) == "\n".join([*texts, ""]).replace(".", "\n").encode()
    assert len(blocks) > 3 and all(block.endswith(b"\n") for block in blocks)
