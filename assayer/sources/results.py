"""Result files: scanning folders of finished runs, writing results."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.cells import two_decimals
from assayer.operators.metrics import report_order

# A result is one CSV file, or a folder named like one with its parts inside.
TAG_PATTERN = r"([^/]+)\.csv(?:/part-[^/]*)?$"


def result_files(
    spark: SparkSession, folder: str, include: list[str] | None = None, exclude: list[str] | None = None
) -> list[tuple[str, str]]:
    """(tag, path) of the CSV results of a folder, sorted, filtered by words of the tag."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path", F.regexp_extract("path", TAG_PATTERN, 1).alias("tag"))
    )
    for word in include or []:
        files = files.filter(F.contains("tag", F.lit(word)))
    for word in exclude or []:
        files = files.filter(~F.contains("tag", F.lit(word)))
    return [(r.tag, r.path) for r in files.orderBy("tag", "path").toLocalIterator()]


def scan_results(
    spark: SparkSession,
    folder: str,
    types: dict[str, str],
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    tag: str = "model",
) -> DataFrame:
    """All rows of the results of a folder, tagged with their file name.

    Lines that start with ``#`` are skipped. Files with the same header are read
    together; different headers are stacked by name with NULL for what a file
    lacks. ``types`` declares the non-text columns.
    """
    files = result_files(spark, folder, include, exclude)
    reader = {"header": True, "comment": "#", "multiLine": True, "escape": '"'}
    by_header = defaultdict(list)
    for _, path in files:
        by_header[tuple(spark.read.options(**reader).csv(path).columns)].append(path)
    if not by_header:
        raise ValueError(f"no result files in {folder}")

    def read(header: tuple, paths: list[str]) -> DataFrame:
        schema = T.StructType.fromDDL(", ".join(f"`{c}` {types.get(c, 'string')}" for c in header))
        rows = spark.read.options(**reader).schema(schema).csv(paths)
        return rows.withColumn(tag, F.regexp_extract(F.col("_metadata.file_path"), TAG_PATTERN, 1))

    frames = [read(header, paths) for header, paths in by_header.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_two_decimals(df: DataFrame) -> DataFrame:
    """Floating columns as texts with two decimals, rounded from their exact values."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(F.col(c).isNotNull(), two_decimals(F.col(c).cast("double"))) for c in floats})


def write_results(runs: DataFrame, path: str) -> None:
    """Write run rows in report order as CSV with two-decimal floats, without prompts."""
    report = with_two_decimals(report_order(runs.drop("prompt")))
    report.write.option("header", True).option("escape", '"').mode("errorifexists").csv(path)


def write_records(runs: DataFrame, path: str) -> None:
    """Write run rows as JSON records."""
    runs.write.mode("errorifexists").json(path)
