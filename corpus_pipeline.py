"""From raw documents to training tokens.

Toxic documents go, of equal texts the largest id stays, of near copies (shingles
of five words, similarity of at least 0.8) the smallest, documents with benchmark
passages go, and the rest is encoded. Every stage reads all that the stage before
it kept, as a stored table.

Null texts count as empty: all empty texts are equal, so one of them stays, and it
is linked with nothing. Of repeated rows one stays. Rows without an id are scored,
deduplicated by their texts and encoded like others. Extra columns of any name go
along until the last stage. An empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import byte_bpe, decontaminate, exact_dedup, jaccard_join, toxicity
from assayer.llm.common import documents, pinned
from assayer.session import table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_equals(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one_of_equals(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each_component(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = byte_bpe.encode_and_decode(docs, ranks, public_tokenizers.PATTERN)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", one_of_equals),
    ("jaccard_join", one_of_near_copies),
    ("decontaminate", without_benchmark),
    ("byte_bpe", encoded),
]

#: Trained scores and token ids are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = pinned(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
