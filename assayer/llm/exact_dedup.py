"""Exact duplicates: local merging, salted merging, global merging, always on whole texts.

Only built-in functions. Texts are shuffled once. The partial aggregation in
front of that shuffle merges equal texts inside each input partition, so a text
that holds a third of all rows leaves each partition as one row. Digests that
more than 1/``slices`` of the rows share are dealt out over salts in addition;
there can be at most ``slices`` of them, which bounds what is broadcast. The
winners of their salts are then combined once more. Every grouping has the
whole text among its keys: two texts with the same digest never merge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import id_and_text, pinned


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_hex,
    slices: int = 1000,
    salts: int = 64,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest.

    Of equal texts the row with the largest id stays. A null text counts as
    empty. Null ids rank below all others; a group without any id has a null
    keep_id. Of repeated rows (same id, same text) exactly one is kept and all
    count in group_size. An empty table gives no rows. Other columns of ``docs``
    are not looked at.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("digest", digest(F.col("text")))
    keys = pinned(rows.select("doc_id", "digest", F.monotonically_increasing_id().alias("at")), "dedup-keys")
    total = keys.count()
    counted = keys.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    # At most `slices` digests can each have more than 1/slices of all rows.
    hot = pinned(counted.where((F.col("n") > salts) & (F.col("n") * slices > total)).select("digest"), "dedup-hot")

    classes = _classes(rows, hot, salts)
    narrow = pinned(classes.drop("text"), "dedup-classes")
    collided = pinned(
        narrow.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "dedup-collided"
    )
    joined = _assigned(keys.join(collided, "digest", "left_anti"), narrow.join(collided, "digest", "left_anti"), hot)
    if not collided.isEmpty():
        members = rows.select("doc_id", "digest", "text", F.monotonically_increasing_id().alias("at"))
        split = members.join(collided, "digest", "left_semi").join(classes, ["digest", "text"])
        joined = joined.unionByName(split.select(*joined.columns))

    # Repeated rows: only the first of those that carry the id to keep is kept.
    repeated = (
        keys.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).where("n > 1")
    ).select(F.col("doc_id").alias("r_id"), F.col("digest").alias("r_digest"), "first")
    marked = joined.join(repeated, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    first = F.col("first").isNull() | (F.col("first") == F.col("at"))
    return marked.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & first).alias("kept"),
        "digest",
    )


def _classes(rows: DataFrame, hot: DataFrame, salts: int) -> DataFrame:
    """One row per distinct text: digest, text, keep_id, group_size."""
    marked = rows.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), "digest", "left")
    salt = F.when(F.col("is_hot"), F.pmod(F.spark_partition_id(), F.lit(salts)) + 1).otherwise(0)
    merged = (
        marked.withColumn("salt", salt)
        .groupBy("digest", "salt", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    winners = (
        merged.where("salt > 0")
        .groupBy("digest", "text")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    return merged.where("salt = 0").drop("salt").unionByName(winners)


def _assigned(keys: DataFrame, classes: DataFrame, hot: DataFrame) -> DataFrame:
    """Members with what their class decided: hot classes are broadcast, the others joined by shuffle."""
    few = F.broadcast(hot)
    hot_classes = classes.join(few, "digest", "left_semi")  # one row for each hot digest
    cold = keys.join(few, "digest", "left_anti").join(classes.join(few, "digest", "left_anti"), "digest")
    warm = keys.join(F.broadcast(hot_classes), "digest")
    return cold.select("doc_id", "digest", "at", "keep_id", "group_size").unionByName(
        warm.select("doc_id", "digest", "at", "keep_id", "group_size")
    )


def keep_one_of_equals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those whose text another row keeps."""
    decided = exact_duplicates(docs, id_col, text_col).where("kept")
    return stay(docs, decided.select(F.col("doc_id"), F.col("digest")), id_col, text_col)


def stay(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` whose (id, digest of text) is in ``kept``; of repeated rows one."""
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).withColumns(
        {"k_id": F.col(f"row.`{id_col}`"), "k_digest": sha256_hex(F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")))}
    )
    wanted = kept.select(F.col("doc_id").alias("w_id"), F.col("digest").alias("w_digest"))
    found = inner.join(wanted, inner.k_id.eqNullSafe(F.col("w_id")) & (F.col("k_digest") == F.col("w_digest")), "left_semi")
    repeated = pinned(inner.groupBy("k_id", "k_digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "dedup-repeated")
    if repeated.isEmpty():
        return found.select("row.*")
    # Only rows that repeat an id and a text completely are grouped.
    again = repeated.select(F.col("k_id").alias("a_id"), F.col("k_digest").alias("a_digest"))
    same = F.col("k_id").eqNullSafe(F.col("a_id")) & (F.col("k_digest") == F.col("a_digest"))
    single = found.join(again, same, "left_anti")
    several = found.join(again, same, "left_semi").dropDuplicates(["k_id", "k_digest"])
    return single.unionByName(several).select("row.*")
