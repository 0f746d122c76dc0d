"""What Python workers hold between stages."""

import pickle

import public_tokenizers

from assayer.llm import byte_bpe, jaccard_join
from assayer.llm.common import released
from assayer.llm.decontaminate import contaminations
from assayer.llm.wordhash import _powers, words_of

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def test_tables_stay_only_for_tasks_that_use_them():
    first = byte_bpe.encoder(PATH, PATTERN)
    list(released(lambda batches: batches, byte_bpe.encoder)(iter([1])))
    assert byte_bpe.encoder(PATH, PATTERN) is first
    list(released(lambda batches: batches)(iter([1])))
    assert byte_bpe.encoder.cache_info().currsize == 0


def test_powers_go_with_the_task():
    list(released(lambda batches: [words_of(["a b"]) for _ in batches])(iter([1])))
    assert _powers.cache_info().currsize == 0


def test_bands_are_kept_once_for_all_tasks():
    jaccard_join._bands.cache_clear()
    rules = [pickle.loads(pickle.dumps(jaccard_join.Rule(80, 5))) for _ in range(3)]
    assert len({rule.bands(100) for rule in rules}) == 1
    assert jaccard_join._bands.cache_info().currsize == 1


def test_a_task_of_decontamination_needs_one_worker(spark, docs):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    found = contaminations(docs([(1, f"so {text} it goes"), (2, "nothing")]), items)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert [(row.doc_id, row.item_id, row.first_word, row.end_word) for row in found.collect()] == [(1, 1, 1, 15)]
