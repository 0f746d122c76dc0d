"""Mining the errors of finished runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.metrics import category_map
from assayer.operators.ordered import attach, ranked, spread_join
from assayer.operators.outcome import QUERY_EXECUTION_ERROR
from assayer.session import materialise

QUESTION_KEYS = ["db_name", "question"]


def short_error(message: Column) -> Column:
    """Text before the first blank line, without the execution prefix."""
    head = F.split_part(message, F.lit("\n\n"), F.lit(1))
    return F.replace(head, F.lit(QUERY_EXECUTION_ERROR.strip()), F.lit(""))


def execution_errors(runs: DataFrame, columns: list[str]) -> DataFrame:
    failed = runs.filter(F.col("error_db_exec") == 1).withColumn("error_msg_short", short_error(F.col("error_msg")))
    return failed.select(*columns).orderBy(*QUESTION_KEYS)


def valid_but_wrong(runs: DataFrame, columns: list[str]) -> DataFrame:
    wrong = runs.filter((F.col("correct") == 0) & (F.col("error_db_exec") == 0))
    return wrong.select(*columns).fillna("").orderBy(*QUESTION_KEYS)


def recurring(runs: DataFrame, by: list[str], keys: list[str] = QUESTION_KEYS) -> DataFrame:
    """All rows of the groups that have more than one row, NULL keys included.

    Counted first and joined back with salt, so a question that recurs in most
    rows does not gather them in one task.
    """
    keyed = runs.withColumn("_key", F.to_json(F.struct(*keys)))
    counted = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    return spread_join(keyed, counted.filter("_n > 1").select("_key"), ["_key"], by=by, how="left_semi").drop("_key")


def distinct_questions(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count_distinct("question").alias("n_questions"))


def bullets(df: DataFrame, col: str, order: list[str]) -> DataFrame:
    """The lines of a bullet list of all values: place (from 0, in order) and line. A writer joins them."""
    numbered = ranked(df, [], order, into="_rank")
    return numbered.select((F.col("_rank") - 1).alias("place"), F.concat(F.lit("- "), F.col(col).cast("string")).alias("line"))


def first_of_each(runs: DataFrame, order: list[str], keys: list[str] = QUESTION_KEYS) -> DataFrame:
    """The first row of every group in the given order; an aggregate, not a window."""
    rest = [c for c in runs.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return runs.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


# Our own definitions of the features of a statement: counts of a pattern, or
# whether it occurs.
COUNTED_FEATURES = {
    "sql_num_tables": r"(?i)\b(?:FROM|JOIN)\s+[A-Za-z_]",
    "sql_num_columns": r"(?i)\b[a-z_]\w*+\.[a-z_]",
    "sql_joins": r"(?i)\bJOIN\b",
}
FLAGGED_FEATURES = {
    "sql_table_alias": r"(?i)\b(?:FROM|JOIN)\s+[\w.]+\s+(?:AS\s+)?(?!(?:WHERE|JOIN|INNER|LEFT|RIGHT|FULL|CROSS|ON|GROUP|ORDER|LIMIT|HAVING|UNION|AS)\b)[a-z]\w*",
    "sql_date_part": r"(?i)\b(?:EXTRACT|DATE_PART|DATE_TRUNC)\s*\(",
    "sql_case_condition": r"(?i)\bCASE\b",
    "sql_group_by": r"(?i)\bGROUP BY\b",
    "sql_order_by": r"(?i)\bORDER BY\b",
    "sql_limit": r"(?i)\bLIMIT\b",
    "sql_distinct": r"(?i)\bDISTINCT\b",
    "sql_having": r"(?i)\bHAVING\b",
    "sql_window": r"(?i)\bOVER\s*\(",
    "sql_subquery": r"(?i)\(\s*SELECT\b",
    "sql_cte": r"(?i)^\s*WITH\b",
    "sql_like": r"(?i)\bI?LIKE\b",
}
UNSUMMED_FEATURES = ["sql_num_tables", "sql_num_columns", "sql_joins", "sql_table_alias"]


def sql_features(sql: Column) -> Column:
    """Counts and flags (0/1) of what a statement uses, as one struct."""
    counts = [F.regexp_count(sql, F.lit(p)).cast("int").alias(n) for n, p in COUNTED_FEATURES.items()]
    flags = [sql.rlike(p).cast("int").alias(n) for n, p in FLAGGED_FEATURES.items()]
    return F.struct(*counts, *flags)


def feature_rows(runs: DataFrame, sql: str = "query") -> DataFrame:
    """One flat row of features per run row, with its label."""
    return runs.withColumn("_f", sql_features(F.col(sql))).select("_f.*", "correct")


def _names(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c != "correct"]


def feature_totals(features: DataFrame, drop: list[str] = UNSUMMED_FEATURES) -> DataFrame:
    """Totals per feature over the wrong rows, largest first."""
    names = [n for n in _names(features) if n not in drop]
    sums = features.filter("correct = 0").agg(*[F.sum(n).alias(n) for n in names])
    return sums.unpivot([], names, "feature", "total").orderBy(F.desc("total"), "feature")


def feature_totals_by_label(features: DataFrame) -> DataFrame:
    """One row per feature with its totals for wrong and for correct rows."""
    names = _names(features)
    sums = features.groupBy("correct").agg(*[F.sum(n).alias(n) for n in names])
    long = sums.unpivot(["correct"], names, "feature", "total")
    return long.groupBy("feature").pivot("correct", [0, 1]).agg(F.sum("total")).select(
        "feature", F.col("0").alias("wrong"), F.col("1").alias("right")
    )


def feature_groups(features: DataFrame, by: list[str]) -> DataFrame:
    """Rows and mean correctness of every combination of the chosen features, worst first."""
    return (
        features.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("mean_correct"))
        .orderBy("mean_correct", F.desc("n"))
    )


def failing_together(features: DataFrame, drop: list[str] = UNSUMMED_FEATURES, least: int = 20, most: int | None = None) -> DataFrame:
    """Sets of features that at least ``least`` wrong rows share, found level by level.

    A row has a feature if its value is above 0. Columns: features (names in the
    order of the columns), n_wrong, n_right, support (the part of all wrong rows that
    has the set) and lift (how much more often rows with the set are wrong than all
    rows). Rows without a label count as neither. ``most`` bounds the size of a set.

    Rows with the same features become one row with two counts, so every level only
    reads distinct rows of features and the frequent sets each of them holds: a set
    grows by one later feature of that row at a time, and is dropped with all that
    grows out of it once too few wrong rows have it.
    """
    names = [n for n in _names(features) if n not in drop]
    present = F.filter(F.array(*[F.when(F.col(f"`{n}`") > 0, F.lit(i)) for i, n in enumerate(names)]), lambda i: i.isNotNull())
    is_wrong, is_right = [F.count(F.when(F.col("correct") == v, 1)) for v in (0, 1)]
    rows = features.select(present.alias("has"), "correct").groupBy("has").agg(is_wrong.alias("wrong"), is_right.alias("right"))
    rows = materialise(rows)
    all_wrong, all_right = rows.agg(F.coalesce(F.sum("wrong"), F.lit(0)), F.coalesce(F.sum("right"), F.lit(0))).first()
    held = rows.where("wrong + right > 0").withColumn("set", F.array().cast("array<int>"))
    found, size = [], 0
    while most is None or size < most:
        later = F.filter("has", lambda i: i > F.coalesce(F.get("set", F.size("set") - 1), F.lit(-1)))
        grown = held.withColumn("_next", F.explode(later)).withColumn("set", F.concat("set", F.array("_next"))).drop("_next")
        sums = grown.groupBy("set").agg(F.sum("wrong").alias("n_wrong"), F.sum("right").alias("n_right"))
        frequent = materialise(sums.where(F.col("n_wrong") >= max(1, least)))
        if frequent.isEmpty():
            break
        found.append(frequent)
        held = materialise(attach(grown, frequent.select("set"), ["set"], by=["has"], how="left_semi"))
        size += 1
    if not found:
        found = [rows.select(F.col("has").alias("set"), F.col("wrong").alias("n_wrong"), F.col("right").alias("n_right")).limit(0)]
    sets = reduce(DataFrame.unionByName, found)
    rate = F.col("n_wrong") / (F.col("n_wrong") + F.col("n_right"))
    named = F.transform("set", lambda i: F.get(F.array(*map(F.lit, names)), i))
    return sets.select(
        named.alias("features"), "n_wrong", "n_right",
        (F.col("n_wrong") / max(1, all_wrong)).alias("support"),
        (rate / (max(1, all_wrong) / max(1, all_wrong + all_right))).alias("lift"),
    )


def summary_record(runs: DataFrame, error_exec_summary: str, valid_wrong_summary: str) -> DataFrame:
    """The category map and the two summary texts as one JSON record."""
    return category_map(runs).select(
        F.to_json(
            F.struct(
                F.col("category_corr").alias("category_corr_dict"),
                F.lit(error_exec_summary).alias("error_exec_summary"),
                F.lit(valid_wrong_summary).alias("valid_wrong_summary"),
            )
        ).alias("summary")
    )
