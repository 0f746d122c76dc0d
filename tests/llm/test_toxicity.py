import random

import pytest

from assayer.llm import toxicity as t

INSULTS = ["grumbol", "snertface", "vilpo"]


def corpus(n=600, seed=1):
    random.seed(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"word{random.randrange(400)}" for _ in range(random.randint(20, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(random.randint(2, 5)):
                words.insert(random.randrange(len(words)), "you " + random.choice(INSULTS))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def labelled(spark):
    def make(labels):
        return spark.createDataFrame([(i, x, 1) for i, x in labels], "doc_id long, toxic int, text int")

    return make


@pytest.fixture(scope="module")
def fitted(spark, labelled):
    rows, labels = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return t.fit(frame, labelled([x for x in labels if x[0] % 4])), rows, labels


def test_held_out_accuracy(fitted, docs):
    model, rows, labels = fitted
    assert set(INSULTS) <= set(model.words)
    got = {r.row.doc_id: (r.score, r.predicted) for r in t.scored(docs(rows), model).collect()}
    held = [(got[i], toxic) for i, toxic in labels if i % 4 == 0]
    assert all(0 <= score <= 1 and predicted == (score >= 0.5) for (score, predicted), _ in held)
    assert sum(predicted == toxic for (_, predicted), toxic in held) >= 0.97 * len(held)


def test_odd_texts(fitted, docs):
    model, *_ = fitted
    rows = [(1, None), (2, ""), (3, " "), (None, "word1 you vilpo"), (4, "word1 " * 30_000), (4, "word1 " * 30_000)]
    got = t.scored(docs(rows), model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert t.scored(docs([]), model).collect() == []


def test_labels_of_one_class_or_none(docs, labelled):
    rows, _ = corpus(30)
    for labels, score in (([], 0.0), ([(1, 0), (2, 0)], 0.0), ([(1, 1)], 1.0), ([(None, 1), (2, None)], 0.0)):
        model = t.fit(docs(rows), labelled(labels))
        assert {r.score for r in t.scored(docs(rows), model).collect()} == {score}


def test_rows_that_stay(docs, labelled):
    rows, labels = corpus()
    frame = docs(rows)
    kept = t.without_toxic(frame, labelled(labels))
    assert kept.columns == frame.columns
    ids = {r.doc_id for r in kept.collect()}
    clean, toxic = {i for i, x in labels if not x}, {i for i, x in labels if x}
    assert len(clean - ids) <= 0.02 * len(clean) and len(toxic & ids) <= 0.05 * len(toxic)


def test_features_by_hand():
    own = t.Describer({"vilpo": 3.0}, {"snert": 2.0})
    found = dict(zip(t.FEATURES, own.features("You VILPO! a snertface, v1lpo b.a.d sooo? "), strict=True))
    assert found["word_density"] == found["stem_density"] == found["obfuscated_density"] == 1 / 7
    assert found["strongest"] == 3.0 and found["second_person_rate"] == 1 / 7
    assert found["near_second_person"] == 3 / 7 and found["shouted_rate"] == 1 / 7
    assert found["obfuscation_rate"] == 2 / 7 and found["stretched_rate"] == 1 / 7
    assert found["exclamation_rate"] == found["question_rate"] == 1 / 7
    assert own.features("a,b;c ...")[t.FEATURES.index("punctuation_rate")] == 5 / 9
    assert own.features("plain words here")[t.FEATURES.index("punctuation_rate")] == 0
    hidden = t.FEATURES.index("obfuscation_rate")
    assert own.features("don't state-of-the-art 1st 2nd it's")[hidden] == 0 and own.features("sh1t s*x f@$t")[hidden] == 1
