import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry_point
import corpus_pipeline as p
from assayer.llm import queries
from assayer.llm.byte_bpe import read_ranks
from assayer.session import table
from tests.llm.test_jaccard_join import plain as components_of

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that go into and come out of every stage."""
    docs, out = table(spark, SF_DIR, "documents"), []
    for name, stage in p.STAGES:
        path = f"{tmp_path_factory.mktemp(name)}/out"
        stage(spark, docs, SF_DIR).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return {name: rest for name, *rest in out}


def test_all_but_the_last_return_documents(stages):
    names = list(stages)
    assert names == ["toxicity", "exact_dedup", "jaccard_join", "decontaminate", "byte_bpe"]
    for name in names[:-1]:
        before, after, columns, kept = stages[name]
        assert columns == kept and set(after) <= set(before)


def test_toxic_documents_go(spark, stages):
    before, after, *_ = stages["toxicity"]
    labels = {r.doc_id: r.toxic for r in table(spark, SF_DIR, "labels").collect()}
    stayed = {r.doc_id for r in after}
    clean = [r.doc_id for r in before if labels.get(r.doc_id) == 0]
    assert sum(i in stayed for i in clean) >= 0.97 * len(clean)


def test_one_of_equals_stays(stages):
    before, after, *_ = stages["exact_dedup"]
    largest = {}
    for r in before:
        largest[r.text] = max(r.doc_id, largest.get(r.text, -1))
    assert {r.doc_id for r in after} == set(largest.values())


def test_one_of_each_component_stays(stages):
    before, after, *_ = stages["jaccard_join"]
    found = components_of([(r.doc_id, r.text) for r in before], 80, 5)
    assert {r.doc_id for r in after} == {i for i, _, component in found if i == component}


def test_benchmark_documents_go(spark, stages):
    before, after, *_ = stages["decontaminate"]
    items = [r.text for r in table(spark, SF_DIR, "benchmark").collect()]
    stayed = {r.doc_id for r in after}
    for r in before:
        if any(item in r.text for item in items):
            assert r.doc_id not in stayed
    assert len(after) >= 0.9 * len(before)


def test_encoding(stages):
    before, after, *_ = stages["byte_bpe"]
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    assert all(r.text == texts[r.doc_id] and r.ids == lib.encode_ordinary(r.text) and r.n_tokens == len(r.ids) for r in after)


def test_run(spark, stages):
    got = p.run(spark, SF_DIR)
    assert {r.doc_id for r in got.select("doc_id").collect()} == {r.doc_id for r in stages["byte_bpe"][1]}


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry_point.queries())


def test_odd_rows_and_names_in_every_stage(spark, tmp_path, docs):
    rows = [(1, None), (2, ""), (3, "plain words that stand here for themselves"), (3, "plain words that stand here for themselves"), (None, "a text without an id"), (5, "word " * 20_000)]
    for given, left in ((rows, {2, 3, None, 5}), ([], set())):
        frame = docs(given)
        for at, (name, stage) in enumerate(p.STAGES):
            path = f"{tmp_path}/{len(given)}-{at}"
            stage(spark, frame, SF_DIR).write.parquet(path)
            after = spark.read.parquet(path)
            assert after.columns == frame.columns or name == "byte_bpe"
            frame = after
        assert sorted((r.doc_id or 0 for r in frame.collect())) == sorted(i or 0 for i in left)
