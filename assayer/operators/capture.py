"""Turning typed result sets into the long ``result_rows`` table.

``result_rows`` has the columns ``pair_id, alt, side, pos, names, tags, vals, err``.
``side`` is 'gold' or 'gen', ``alt`` numbers the gold alternatives from 0 and is
NULL for the generated side, ``pos`` is the 0-based place of the row in its
result. A result without rows and a statement that failed are each kept as one
row with a NULL ``pos``, the latter with its message in ``err``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.cells import CELL, cell, tag_of
from assayer.session import materialise

RESULT_ROWS = (
    "pair_id bigint, alt int, side string, pos bigint, names array<string>, tags array<string>, "
    f"vals array<{CELL}>, err string"
)


def unique_labels(names: list[str]) -> list[str]:
    """Every copy of a repeated name gets its position as a suffix."""
    return [f"{n}_{i}" if names.count(n) > 1 else n for i, n in enumerate(names)]


def unique_names(names: Column) -> Column:
    """The same rule for an array column of names."""

    def label(name: Column, place: Column) -> Column:
        copies = F.size(F.filter(names, lambda other: other == name))
        return F.when(copies > 1, F.concat(name, F.lit("_"), place.cast("string"))).otherwise(name)

    return F.transform(names, label)


def number_rows(df: DataFrame, into: str = "pos") -> DataFrame:
    """Number rows from 0 in their present order, keeping them distributed."""
    tagged = df.withColumn("_part", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    pinned = materialise(tagged)
    sizes = pinned.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        pinned.join(starts, "_part")
        .withColumn(into, F.col("_start") + local)
        .drop("_part", "_mid", "_start")
    )


def long_rows(
    df: DataFrame,
    pair_id: Column,
    side: str,
    pos: Column,
    columns: list[str] | None = None,
    alt: int | Column | None = None,
    decimals: int | None = None,
    names: list[str] | None = None,
) -> DataFrame:
    """``result_rows`` for a typed frame; one frame may hold many pairs."""
    columns = columns or df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    alt_col = alt if isinstance(alt, Column) else F.lit(alt)
    return df.select(
        pair_id.cast("bigint").alias("pair_id"),
        alt_col.cast("int").alias("alt"),
        F.lit(side).alias("side"),
        pos.cast("bigint").alias("pos"),
        F.array(*[F.lit(n) for n in (names or columns)]).alias("names"),
        F.array(*[F.lit(tag_of(types[c])) for c in columns]).alias("tags"),
        F.array(*[cell(F.col(c), types[c], decimals) for c in columns]).alias("vals"),
        F.lit(None).cast("string").alias("err"),
    )


def outcome_row(spark, pair_id: int, side: str, alt: int | None, df: DataFrame | None, err: str | None) -> DataFrame:
    """The placeholder row of an empty or failed result."""
    names = list(df.columns) if df is not None else []
    tags = [tag_of(f.dataType) for f in df.schema.fields] if df is not None else []
    return spark.createDataFrame([(pair_id, alt, side, None, names, tags, None, err)], RESULT_ROWS)


def capture(
    df: DataFrame, pair_id: int, side: str, alt: int | None = None, decimals: int | None = None
) -> DataFrame:
    """``result_rows`` of one result whose present row order is its order.

    The placeholder row is always added: it keeps the column names when the
    result turns out to be empty and is ignored otherwise.
    """
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    rows = long_rows(
        number_rows(plain), F.lit(pair_id), side, F.col("pos"), plain.columns, alt, decimals, names=df.columns
    )
    return rows.unionByName(outcome_row(df.sparkSession, pair_id, side, alt, df, None))
