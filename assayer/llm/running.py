"""Running sums over a whole table in a given order, without a window over all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from assayer.llm.common import pinned


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str], label: str) -> DataFrame:
    """``df`` with a column for each of ``sums`` (new name: long column, not negative, never null): the sum up to and with the row.

    Rows are range-partitioned and sorted by ``order`` (which should tell all rows
    apart), so that a group of any size lies in many slices. Each task adds up its
    slice as it streams by; what lies before a slice is known from one row for each
    slice, of which there are as many as shuffle partitions. The result is stored.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names, values = [*sums], [*sums.values()]
    columns = df.columns

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, totals = TaskContext.get().partitionId(), [0] * len(values)
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = []
            for k, value in enumerate(values):
                run = np.cumsum(batch.column(value).to_numpy(zero_copy_only=False)) + totals[k]
                totals[k] = int(run[-1])
                runs.append(pa.array(run, pa.int64()))
            at = pa.array(np.full(batch.num_rows, part, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, *runs, at], [*columns, *names, "_slice"])

    schema = StructType([*df.schema.fields, *(StructField(name, LongType()) for name in names), StructField("_slice", IntegerType())])
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    stored = pinned(placed.mapInArrow(added, schema), label)
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored.groupBy("_slice").agg(*[F.max(name).alias(name) for name in names])
    before = totals.select("_slice", *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_{name}") for name in names])
    whole = stored.join(F.broadcast(before), "_slice")
    return whole.select(*columns, *[(F.col(name) + F.col(f"_{name}")).alias(name) for name in names])
