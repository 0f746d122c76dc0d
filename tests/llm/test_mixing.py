import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import mixing as m

SMALL = m.Size(words=200, counted=150, slot_bits=14, fit_texts=100)


def texts(n=260, seed=1):
    random.seed(seed)
    parts = ["ta", "ri", "on", "sel", "bo", "mé", "x"]
    made = []
    for i in range(n):
        words = [random.choice(["the", "of", "and", "The"]) if random.random() < 0.4 else "".join(random.choice(parts) for _ in range(random.randint(1, 4))) for _ in range(random.randint(1, 60))]
        made.append((i, " ".join(words)))
    return made


def plain_base(rows, held):
    split = [(i, (t or "").encode().lower().split()) for i, t in rows]
    counts = collections.Counter()
    for i, words in split:
        if not held(i):
            counts.update([*words, None])
    n, v = sum(counts.values()), len(counts)
    return [
        (i, held(i), len(w) + 1, sum(counts[x] > 0 for x in [*w, None]), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in [*w, None]), 6)) for i, w in split
    ]


def held(i):
    return i is not None and i % 5 == 2


def held_column():
    return F.col("doc_id") % 5 == 2


def test_base_scores_and_edge_cases(docs):
    rows = [*texts(), (300, None), (301, ""), (302, " \n"), (None, "the of zzz"), (303, "qq qq ww"), (303, "qq qq ww"), (307, "unseen words here"), (307, "unseen words here"), (304, "the " * 20_000), (305, "y" * 30_000)]
    got = m.scored(docs(rows).repartition(3), held_column(), size=SMALL).collect()
    found = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    assert sorted(found, key=str) == sorted(plain_base(rows, held), key=str)
    assert all(r.score < 0 and math.isfinite(r.score) and r.bits_per_byte > 0 for r in got)


def tongues(n=900):
    """Texts in three invented languages; which words come depends on the language and on the word before."""
    random.seed(5)
    words = [[f"{a}{b}{c}" for b in "aeiou" for c in "nrstlm"] for a in "pkg"]
    out = []
    for i in range(n):
        own, text, at = random.choice(words), [], 0
        for _ in range(random.randint(10, 60)):
            at = (at * 3 + random.randrange(6)) % len(own)
            text.append(own[at])
        out.append((i, " ".join(text)))
    return out


def test_held_out_texts_beat_the_base(docs):
    rows = tongues()
    got = [r for r in m.scored(docs(rows), held_column(), size=SMALL).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.75 * sum(r.base_score for r in got)
    shuffled = [(i, t if not held(i) else "".join(random.sample(t, len(t)))) for i, t in rows]
    mixed = [r for r in m.scored(docs(shuffled), held_column(), size=SMALL).collect() if r.held_out]
    assert sum(r.bits_per_byte for r in mixed) > 2 * sum(r.bits_per_byte for r in got)


def test_same_scores_however_the_rows_are_dealt(docs):
    rows = texts(200)
    one, two = ({r.doc_id: r.score for r in m.scored(docs(rows).repartition(n), held_column(), size=SMALL).collect()} for n in (1, 6))
    assert all(abs(one[i] - two[i]) < 1e-3 * abs(one[i]) for i in one)


def test_empty_table_and_nothing_to_learn_from(docs):
    assert m.scored(docs([]), held_column(), size=SMALL).collect() == []
    (row,) = m.scored(docs([(2, "a b")]), held_column(), size=SMALL).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0) and row.score < 0


@pytest.mark.parametrize("counts", [[5, 1, 1], [1, 1], [1000, 3, 3, 1, 1, 50, 7]])
def test_codes_are_complete(counts):
    code = m.Code(counts)
    assert abs(sum(2.0 ** -int(s) for s in code.sizes) - 1) < 1e-12
    paths = {tuple(code.bits[a:b].tolist()) for a, b in zip(code.first, code.first[1:], strict=False)}
    assert len(paths) == len(counts)


def test_probabilities_of_all_continuations_sum_to_one():
    """Bits of a symbol are predicted by what stands before it only: over all symbols at a place, probabilities add up."""
    code = m.Code([8, 4, 2, 1, 1])
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, (2, m.CONTEXTS, 1 << 10, 2)).astype(np.float32)
    corpus = m.Corpus(10, 3, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), code, code)
    total = 0.0
    for symbol in range(5):
        scorer = m.Scorer(corpus, m.Slots.of(counts), m.Weights.first(), 10)
        stream = m.Stream(code, np.zeros(1, np.int64), np.array([symbol]), [np.full(1, 7 * k + 1, np.uint32) for k in range(m.CONTEXTS)])
        cost = np.zeros(1)
        scorer._blocks(0, m.expanded(stream, slice(None), 10), np.array([0, int(code.sizes[symbol])]), np.zeros((1, m.CONTEXTS + 1), np.float32), np.zeros((1, m.INTERVALS), np.float32), cost)
        total += math.exp(-cost[0])
    assert abs(total - 1) < 1e-4


@pytest.fixture
def weights_of(docs, monkeypatch):
    """The weights fitted on rows, and the scores."""
    fitted, made = m.fitted_weights, []
    monkeypatch.setattr(m, "fitted_weights", lambda *given: made.append(fitted(*given)) or made[-1])

    def run(rows, size):
        got = m.scored(docs(rows), held_column(), size=size).collect()
        return made.pop(), got

    return run


def test_long_texts_are_fitted_too(weights_of):
    rows = [(i, " ".join([t] * 3)) for i, t in tongues(60)]
    weights, _ = weights_of(rows, m.Size(words=200, counted=150, slot_bits=14, fit_texts=100, fit_bytes=1_000))
    first = m.Weights.first()
    assert np.abs(weights.mixing[0] - first.mixing[0]).max() > 0.01 and np.abs(weights.refining[0]).max() > 0


def test_all_texts_move_the_weights_however_few_fit_in_a_group(weights_of, spark):
    """A group of copies whose hash is the least does not keep other texts out, and no copy is left in the slots."""
    rows = tongues()
    least = spark.createDataFrame([(f"copy number {i} of a text",) for i in range(5_000)], "text string").orderBy(F.xxhash64("text")).first().text
    copied = rows + [(5 * i, least) for i in range(1_000, 1_150)]
    (_, scores), (_, beside_copies) = weights_of(rows, SMALL), weights_of(copied, SMALL)
    one, two = ({r.doc_id: r.bits_per_byte for r in got if r.held_out} for got in (scores, beside_copies))
    assert sum(two.values()) < 1.005 * sum(one.values())


def test_texts_adapt_from_their_first_bits_on_and_long_ones_as_often():
    block = m.block_of(np.arange(200_000))
    steps = np.diff(np.flatnonzero(np.diff(block, prepend=-1)), append=0)[:-1]
    assert steps[:6].tolist() == [32, 32, 64, 128, 256, 512] and set(steps[6:].tolist()) == {m.BLOCK}
    assert set(np.diff(block).tolist()) == {0, 1}
