"""Order-dependent work inside groups of any size.

A window over a whole group would put the group into one task. Here the rows
are range-partitioned on (group, order) first, so that even one group that
holds most rows is cut into many slices; windows only ever cover one slice, or
one row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.session import materialise

_SLICE = "_slice"


#: Counters of the summary of keys, and the part of all rows from which on a key is heavy.
TRACKED, HEAVY_PART = 16_384, 1000


def heavy_keys(big: DataFrame, keys: list[str]) -> DataFrame:
    """_hash and _salts of every key that holds more than 1/HEAVY_PART of the rows; some 1,300 rows at most.

    Found in one pass by a mergeable summary. Its counts are too high by at most
    3.5 / TRACKED of all rows, so no heavy key is missed and every key it names
    holds at least 1/1,300. A key gets a salt for every partition of its size.
    """
    spark = big.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = F.call_function("approx_top_k", F.xxhash64(*keys), F.lit(2000), F.lit(TRACKED))
    found = big.agg(F.count(F.lit(1)).alias("n"), top.alias("top")).first()
    heavy = [(hit["item"], max(2, -(-4 * hit["count"] * parts // found.n))) for hit in found.top or [] if hit["count"] * HEAVY_PART > found.n]
    return spark.createDataFrame(heavy, "_hash bigint, _salts int")


def copied(small: DataFrame, keys: list[str], heavy: DataFrame) -> DataFrame:
    """``small`` with _salt: a row for each salt of a heavy key, one row for any other."""
    salts = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    marked = small.withColumn("_hash", F.xxhash64(*keys)).join(F.broadcast(heavy), "_hash", "left")
    return marked.withColumn("_salt", F.explode(salts)).drop("_hash", "_salts")


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """Attach per-key attributes without gathering a heavy key's rows in one task.

    The rows of a heavy key are dealt by a hash of the columns ``by`` over copies
    of its attribute rows; other keys have one copy. The salt is a key of the join,
    so its partitioning never serves a later grouping on ``keys``. ``big`` is read
    twice and should be stored. Spark remains free to broadcast ``small`` where
    its size allows it.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"unsupported join type {how}")
    heavy = heavy_keys(big, keys)
    salt = F.pmod(F.xxhash64(*by), F.coalesce("_salts", F.lit(1))).cast("int")
    marked = big.withColumn("_hash", F.xxhash64(*keys)).join(F.broadcast(heavy), "_hash", "left")
    dealt = marked.withColumn("_salt", salt).drop("_hash", "_salts")
    return dealt.join(copied(small, keys, heavy), [*keys, "_salt"], how).drop("_salt")


# A side is broadcast only after its rows were measured to stay below this size.
BROADCAST_BYTES = 16 * 1024 * 1024


def fits_broadcast(small: DataFrame) -> bool:
    """Measure materialised rows: do they stay within ``BROADCAST_BYTES``?"""
    size = small.agg(F.sum(F.length(F.to_json(F.struct(*small.columns)))).alias("bytes")).first().bytes or 0
    return size <= BROADCAST_BYTES


def attach(
    big: DataFrame, small: DataFrame, keys: list[str], by: list[str], how: str = "inner", fits: bool | None = None
) -> DataFrame:
    """Join per-key attributes that were materialised before.

    The attributes are measured, unless the caller has measured the rows they
    were cut from: within ``BROADCAST_BYTES`` they go to every task and ``big``
    is not shuffled; beyond that the salted join takes over.
    """
    if fits_broadcast(small) if fits is None else fits:
        return big.join(F.broadcast(small), keys, how)
    return spread_join(big, small, keys, by, how)


def _sliced(df: DataFrame, group: list[str], order: list[Column | str]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *group, *order).withColumn(_SLICE, F.spark_partition_id())


def lowest_running_sum(df: DataFrame, group: list[str], order: list[str], delta: str) -> DataFrame:
    """Per group, the lowest value the running sum of ``delta`` reaches."""
    in_slice = Window.partitionBy(*group, _SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return (
        _sliced(df, group, order)
        .withColumn("_run", F.sum(delta).over(in_slice))
        .groupBy(*group, _SLICE)
        .agg(F.sum(delta).alias("_total"), F.min("_run").alias("_low"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
        .groupBy(*group)
        .agg(F.min(F.col("_before") + F.col("_low")).alias("lowest"))
    )


def running_totals(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add running sums over the rows of each group in the given order.

    Slices are pinned in the checkpoint folder, because slice totals and slice
    contents are read separately and must agree even after a lost executor.
    """
    values = df.withColumns({f"_v_{name}": value for name, value in sums.items()})
    pinned = materialise(_sliced(values, group, order))
    earlier = Window.partitionBy(*group).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    in_slice = Window.partitionBy(*group, _SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = pinned.groupBy(*group, _SLICE).agg(*[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums])
    offsets = totals.select(
        *group, _SLICE, *[F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_b_{name}") for name in sums]
    )
    summed = (
        pinned.withColumns({f"_l_{name}": F.sum(f"_v_{name}").over(in_slice) for name in sums})
        .join(offsets, [*group, _SLICE])
        .withColumns({name: F.col(f"_b_{name}") + F.col(f"_l_{name}") for name in sums})
    )
    return summed.drop(_SLICE, *[f"_{k}_{name}" for k in "vlb" for name in sums])


def ranked(df: DataFrame, group: list[str], order: list[str], into: str = "rank") -> DataFrame:
    """Number the rows of each group from 1 in the given order.

    Range slices are sorted and pinned in the checkpoint folder with the place
    of every row in its slice. The place in the whole order is then the size of
    the earlier slices plus that place, and the place in a group what lies
    behind the first row of the group: one shuffle, whatever the group sizes.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order]
    placed = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    pinned = materialise(placed.withColumn("_mid", F.monotonically_increasing_id()))
    pinned = pinned.withColumns({_SLICE: F.shiftright("_mid", 33), "_at": F.expr("_mid & 8589934591")}).drop("_mid")
    heads = materialise(
        pinned.groupBy(*group, _SLICE).agg(F.min("_at").alias("_head"), F.count(F.lit(1)).alias("_n"))
    )
    earlier = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    sizes = heads.groupBy(_SLICE).agg(F.sum("_n").alias("_n"))
    # One row per slice, and there are as many slices as shuffle partitions.
    starts = sizes.select(_SLICE, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    whole = pinned.join(F.broadcast(starts), _SLICE).withColumn(into, F.col("_start") + F.col("_at") + 1)
    if not group:
        return whole.drop(_SLICE, "_start", "_at")
    firsts = heads.join(F.broadcast(starts), _SLICE).groupBy(*group).agg(
        F.min(F.col("_start") + F.col("_head")).alias("_first")
    )
    grouped = attach(whole, firsts, group, by=["_at", _SLICE])
    return grouped.withColumn(into, F.col(into) - F.col("_first")).drop(_SLICE, "_start", "_at", "_first")
