"""Named databases for statements: file tables, JDBC sources, empty schemas."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.cells import round_half_even, tag_of
from assayer.functions.metadata import clean_metadata, column_types
from assayer.session import table


def table_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the Parquet tables (files or folders) of a folder, on any file system Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(conf).listStatus(path)
    names = [status.getPath().getName() for status in listed]
    return sorted(name.removesuffix(".parquet") for name in names if name.endswith(".parquet"))


def load_database(spark: SparkSession, folder: str, names: list[str] | None = None) -> list[str]:
    """Register the Parquet tables of a folder (all that are there, or some) as views and return their names."""
    names = list(names or table_names(spark, folder))
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
    return names


def own_session(spark: SparkSession) -> SparkSession:
    """A session with views of its own on the same cluster, with the settings of ``spark`` that queries depend on."""
    new = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        new.conf.set(key, spark.conf.get(key))
    return new


def database_session(spark: SparkSession, folder: str, names: list[str] | None = None) -> SparkSession:
    """A session in which the tables of ``folder`` are the views: databases may share table names."""
    new = own_session(spark)
    load_database(new, folder, names)
    return new


def rounded(df: DataFrame, decimals: int | None) -> DataFrame:
    """Floating columns rounded half to even; 0 or None keeps them."""
    if not decimals:
        return df
    floats = {f.name for f in df.schema.fields if tag_of(f.dataType) == "f"}
    return df.select(
        *[round_half_even(F.col(c), decimals).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


def run_query(spark: SparkSession, sql: str, decimals: int | None = None) -> DataFrame:
    """The result of a statement on the registered tables."""
    return rounded(spark.sql(sql.strip().rstrip(";")), decimals)


def run_jdbc(spark: SparkSession, url: str, sql: str, decimals: int | None = None, **options: str) -> DataFrame:
    """The result of a statement pushed whole to an external database.

    The JDBC driver of that database must be on the classpath of the session.
    """
    reader = spark.read.format("jdbc").option("url", url).option("query", sql.strip().rstrip(";"))
    return rounded(reader.options(**options).load(), decimals)


def schema_session(spark: SparkSession, ddl: str) -> SparkSession:
    """A session whose views are the tables of a DDL text, without rows."""
    new = own_session(spark)
    create_empty(new, ddl)
    return new


def create_empty(spark: SparkSession, ddl: str) -> list[str]:
    """Views without rows for the tables of a DDL text; their names."""
    described = (
        spark.range(1)
        .select(F.explode(column_types(clean_metadata(F.lit(ddl)))).alias("t"))
        .select("t.table", "t.fields")
        .collect()
    )
    names = []
    for row in described:
        name = re.sub(r'["`]', "", row.table).rsplit(".", 1)[-1]
        spark.createDataFrame([], T.StructType.fromDDL(row.fields)).createOrReplaceTempView(name)
        names.append(name)
    return names


def sessions_of(spark: SparkSession, databases: dict[str, str]) -> dict[str, SparkSession]:
    """A session for each database name: its value is a folder of tables or a DDL text."""
    return {
        name: schema_session(spark, source) if "create table" in source.lower() else database_session(spark, source)
        for name, source in databases.items()
    }
