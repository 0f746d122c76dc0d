"""Operators of the question-table translation workflow.

Lists of alternatives stay short arrays (one entry per acceptable statement);
everything per row is an array expression, everything across rows a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The markers of an annotated statement.
BAD_MARK = "<INVALID ERR MSG>: "
TRANSLATION_MARK = "<INVALID TRANSLATION>: "
ORIGIN_MARK = "<ORIG POSTGRES>: "
RULE = "-----------------"
LEADING_COLUMNS = ["db_name", "db_type", "query_category", "query", "question"]


def map_list(df: DataFrame, source: str, into: str, fn: Callable[[Column], Column]) -> DataFrame:
    """Apply an expression to every alternative of a row."""
    return df.withColumn(into, F.transform(source, fn))


def per_alternative(df: DataFrame, lists: dict[str, str]) -> DataFrame:
    """One row per alternative: parallel lists become the named columns, ``alt`` the place."""
    zipped = F.arrays_zip(*[F.col(c).alias(n) for c, n in lists.items()])
    rest = [c for c in df.columns if c not in lists]
    return df.select(*rest, F.posexplode(zipped).alias("alt", "_z")).select(
        *rest, "alt", *[F.col(f"_z.{n}").alias(n) for n in lists.values()]
    )


def regroup(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Back to parallel lists in ``alt`` order; a group holds one row's alternatives."""
    items = F.array_sort(F.collect_list(F.struct("alt", *columns)))
    grouped = df.groupBy(*keys).agg(items.alias("_items"))
    return grouped.select(*keys, *[F.col(f"_items.{c}").alias(n) for c, n in columns.items()])


def any_invalid(valid: Column) -> Column:
    return F.exists(valid, lambda v: ~v)


def all_valid(valid: Column) -> Column:
    return F.forall(valid, lambda v: v)


def upsert(base: DataFrame, fixes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Take the listed columns from ``fixes`` where it has the row, else keep them."""
    fixed = fixes.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = base.join(fixed, key, "left")
    return joined.select(
        *[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else c for c in base.columns]
    )


def annotate_invalid(sqls: Column, valid: Column, errors: Column, origins: Column) -> Column:
    """Replace each invalid statement by its error, its text and its origin."""
    return F.transform(
        F.arrays_zip(sqls.alias("s"), valid.alias("v"), errors.alias("e"), origins.alias("o")),
        lambda z: F.when(
            ~z["v"],
            F.concat(
                F.lit(BAD_MARK), z["e"], F.lit(RULE + TRANSLATION_MARK), z["s"], F.lit(RULE + ORIGIN_MARK), z["o"], F.lit(RULE)
            ),
        ).otherwise(z["s"]),
    )


def join_statements(sqls: Column) -> Column:
    return F.concat(F.array_join(sqls, ";"), F.lit(";"))


def read_annotations(text: Column) -> Column:
    """Array of (sql, err, valid) from a text of annotated statements."""
    items = F.filter(F.split(text, ";"), lambda s: s != "")

    def between(item: Column, mark: str) -> Column:
        return F.substring_index(F.split_part(item, F.lit(mark), F.lit(2)), RULE, 1)

    def entry(item: Column) -> Column:
        bad = F.contains(item, F.lit(BAD_MARK.strip()))
        translated = F.contains(item, F.lit(TRANSLATION_MARK.strip()))
        return F.struct(
            F.when(translated, between(item, TRANSLATION_MARK)).otherwise(item).alias("sql"),
            F.when(bad, between(item, BAD_MARK)).otherwise(F.lit("")).alias("err"),
            (~bad).alias("valid"),
        )

    return F.transform(items, entry)


def finish_table(df: DataFrame, dialect: str, query_col: str, drop: list[str]) -> DataFrame:
    """Fill nulls, set the dialect, put the translated text in ``query``, order the columns."""
    shaped = df.drop("query", *drop).withColumnRenamed(query_col, "query").withColumn("db_type", F.lit(dialect)).fillna("")
    rest = [c for c in shaped.columns if c not in LEADING_COLUMNS]
    return shaped.select(*LEADING_COLUMNS, *rest)


def contains_text(col: Column, wanted: str) -> Column:
    """Case-insensitive containment; a NULL does not contain anything."""
    return F.coalesce(F.contains(F.lower(col), F.lit(wanted.lower())), F.lit(False))


def without_repeats(items: Column) -> Column:
    return F.array_distinct(items)


def update_if_valid(df: DataFrame, at: Column, valid: Column, changes: dict[str, Column]) -> DataFrame:
    """Change the chosen rows, and only where all replacements are valid."""
    hit = at & all_valid(valid)
    return df.withColumns({c: F.when(hit, new).otherwise(F.col(c)) for c, new in changes.items()})


def same_row(left: DataFrame, sibling: DataFrame, row: str, columns: dict[str, str]) -> DataFrame:
    """Columns of a sibling table at the same row number."""
    picked = sibling.select(row, *[F.col(c).alias(n) for c, n in columns.items()])
    return left.join(picked, row)


def sample_one(df: DataFrame, key: str, seed: int) -> DataFrame:
    """One row picked by a seeded hash: repeatable, and a top-1 instead of a sort."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(1)
