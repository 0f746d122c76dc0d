"""Builders for the shapes of analytical question the engine is asked to judge.

Every builder only states the logical plan. Joins to dimension tables carry no
hint: Spark sees the size of the files and broadcasts what is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.ordered import ranked, spread_join


def money(value: Column) -> Column:
    """An exact sum of amounts with two decimals, as a double."""
    return F.sum(value.cast("decimal(18,2)")).cast("double")


def top_groups(df: DataFrame, keys: list[str], measures: dict[str, Column], order: list[Column], limit: int | None = None, drop: list[str] | None = None) -> DataFrame:
    """Group, aggregate, order and keep the first rows; ``drop`` hides group keys."""
    grouped = df.groupBy(*keys).agg(*[m.alias(name) for name, m in measures.items()]).orderBy(*order)
    return (grouped.limit(limit) if limit else grouped).drop(*(drop or []))


def since_days(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    return df.filter(F.col(ts) >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL '{days}' DAY"))


def since_months(df: DataFrame, ts: str, as_of: str, months: int, whole: bool = False) -> DataFrame:
    """Rows of the last months; ``whole`` starts at the first day of that month."""
    start = F.add_months(F.lit(as_of).cast("date"), -months)
    start = F.trunc(start, "month") if whole else start
    return df.filter(F.col(ts) >= start.cast("timestamp_ntz"))


def between_days(df: DataFrame, ts: str, first: str, last: str) -> DataFrame:
    """Rows from the start of ``first`` to the given last moment, both included."""
    return df.filter(F.col(ts).between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")))


def half_open(df: DataFrame, ts: str, first: str, end: str) -> DataFrame:
    """Rows from ``first`` up to but not including ``end``."""
    return df.filter(
        (F.col(ts) >= F.lit(first).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz"))
    )


def month_start(ts: str) -> Column:
    return F.trunc(F.col(ts).cast("date"), "month")


def month_from_parts(ts: str) -> Column:
    return F.make_date(F.year(ts), F.month(ts), F.lit(1))


def month_text(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM")


def distinct_partners(left: DataFrame, right: DataFrame, on: Column, columns: list[str]) -> DataFrame:
    """Distinct rows of ``left`` with a partner: a semi join, nothing is multiplied."""
    return left.join(right, on, "left_semi").select(*columns).distinct()


def without_partner(left: DataFrame, right: DataFrame, on: Column, columns: list[str]) -> DataFrame:
    """Rows of ``left`` without a partner.

    Written as an anti join: LEFT JOIN ... IS NULL would first build the whole
    outer join and then filter it.
    """
    return left.join(right, on, "left_anti").select(*columns)


def ranked_groups(df: DataFrame, keys: list[str], measure: Column, into: str) -> DataFrame:
    """Rank the groups by an aggregate, largest first, ties sharing a rank.

    The groups are numbered over range slices, so a grouping with very many
    groups does not pass through one task.
    """
    grouped = df.groupBy(*keys).agg(measure.alias(into))
    tie = F.coalesce(F.col(into).cast("string"), F.lit("NULL"))
    keyed = grouped.withColumns({"_tie": tie, "_null": F.col(into).isNull(), "_fall": -F.col(into)})
    numbered = ranked(keyed, [], ["_null", "_fall", *keys], into="_number")
    firsts = numbered.groupBy("_tie").agg(F.min("_number").alias("place"))
    return spread_join(numbered, firsts, ["_tie"], by=keys).drop("_tie", "_null", "_fall", "_number")
