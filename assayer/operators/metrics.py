"""Run metrics: rates by category, model and checkpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.cells import exact_hundredths
from assayer.operators.ordered import running_totals

# The evaluation sets in report order, and the file-name patterns.
EVAL_ORDER = ["basic", "v1", "advanced", "idk"]
BENCHMARK_PATTERN = r"_(advanced|basic|v1|idk)"
CHECKPOINT_PATTERN = r"c(\d+)_"
COT_PATTERN = r"_(cot)"
METRIC_PREFIX = "vllm/"


def category_report(runs: DataFrame, with_count: bool = False, metrics: list[Column] | None = None) -> DataFrame:
    """Mean correctness and execution errors per category; rows without one are left out.

    ``with_count`` adds the number of rows that name a database; further
    aggregate columns can be passed in ``metrics``.
    """
    aggregates = [F.avg("correct").alias("mean_correct"), F.avg("error_db_exec").alias("mean_error_db_exec")]
    if with_count:
        aggregates.insert(0, F.count("db_name").alias("num_rows"))
    return (
        runs.filter(F.col("query_category").isNotNull()).groupBy("query_category").agg(*aggregates, *(metrics or []))
    )


def overall_rate(runs: DataFrame) -> DataFrame:
    return runs.agg(F.try_divide(F.sum("correct"), F.count(F.lit(1))).alias("rate"))


def running_accuracy(runs: DataFrame, run: list[str], order: list[str]) -> DataFrame:
    """Correct and tried so far, in completion order, with the percentage."""
    summed = running_totals(
        runs, run, order, {"correct_so_far": F.col("correct").cast("bigint"), "tried_so_far": F.lit(1).cast("bigint")}
    )
    percent = 100 * F.col("correct_so_far") / F.col("tried_so_far")
    return summed.withColumn("percent", exact_hundredths(percent).cast("double") / 100)


def total_cost(runs: DataFrame) -> DataFrame:
    return runs.agg(F.sum("cost_in_cents").alias("total_cents"))


def category_rates(runs: DataFrame, descending: bool = True) -> DataFrame:
    """Mean correctness per category, best or worst first."""
    order = F.desc("correct") if descending else F.asc("correct")
    rates = runs.filter(F.col("query_category").isNotNull()).groupBy("query_category")
    return rates.agg(F.avg("correct").alias("correct")).orderBy(order, "query_category")


def category_map(runs: DataFrame) -> DataFrame:
    """The rates as one map, worst category first; it holds one entry per category."""
    rates = category_rates(runs, descending=False)
    entries = F.array_sort(F.collect_list(F.struct("correct", "query_category")))
    ordered = F.transform(entries, lambda e: F.struct(e["query_category"].alias("k"), e["correct"].alias("v")))
    return rates.agg(F.map_from_entries(ordered).alias("category_corr"))


def eval_rank(eval_type: Column) -> Column:
    """Place of an evaluation set in the report order; NULL for others."""
    place = F.array_position(F.array(*[F.lit(e) for e in EVAL_ORDER]), eval_type)
    return F.when(place > 0, place)


def model_report(runs: DataFrame) -> DataFrame:
    """Mean correctness by model, set, checkpoint and mode, unpivoted to (metric, correct_pct)."""
    keys = ["model", "eval_type", "checkpoint", "cot_inference"]
    filled = runs
    for key in keys:
        filled = filled.filter(F.col(key).isNotNull())
    means = filled.groupBy(*keys).agg(F.avg("correct").alias("correct"))
    long = means.unpivot(keys, ["correct"], "metric", "correct_pct")
    rank = eval_rank(F.col("eval_type"))
    return long.withColumn("eval_rank", rank).withColumn(
        "eval_type", F.when(rank.isNotNull(), F.col("eval_type"))
    )


def file_tags(name: Column) -> dict[str, Column]:
    """Benchmark, checkpoint number and mode of a result file name."""
    checkpoint = F.nullif(F.regexp_extract(name, CHECKPOINT_PATTERN, 1), F.lit(""))
    return {
        "benchmark": F.nullif(F.regexp_extract(name, BENCHMARK_PATTERN, 1), F.lit("")),
        "checkpoint": checkpoint.cast("int"),
        "cot": F.coalesce(F.nullif(F.regexp_extract(name, COT_PATTERN, 1), F.lit("")), F.lit("no_cot")),
    }


def split_tail(name: Column) -> dict[str, Column]:
    """The part before and the part after the last underscore."""
    tail = F.substring_index(name, "_", -1)
    cut = F.length(name) - F.length(tail) - 1
    return {"stem": F.when(cut >= 0, F.substring(name, F.lit(1), cut)).otherwise(name), "tail": F.when(cut >= 0, tail)}


def model_file_tags(name: Column, model: Column) -> dict[str, Column]:
    """Checkpoint, set and mode of a file name that starts with the model name."""
    rest = F.split_part(name, model, F.lit(2))
    return {
        "checkpoint": F.split_part(rest, F.lit("_"), F.lit(2)),
        "eval_type": F.replace(F.substring_index(name, "_", -1), F.lit(".csv"), F.lit("")),
        "cot_inference": F.when(F.contains(name, F.lit("_cot")), "cot").otherwise("no_cot"),
    }


def checkpoint_metrics(rates: DataFrame, offset: int = 0) -> DataFrame:
    """One row per checkpoint with a column per (benchmark, mode), ascending.

    A value is given only where exactly one row qualifies.
    """
    metrics = [f"{METRIC_PREFIX}{b}{m}" for b in ("advanced", "basic", "v1", "idk") for m in ("_cot", "")]
    suffix = F.when(F.col("cot") == "cot", F.lit("_cot")).otherwise("")
    named = rates.withColumn("metric", F.concat(F.lit(METRIC_PREFIX), "benchmark", suffix))
    wide = named.groupBy("checkpoint").pivot("metric", metrics).agg(
        F.when(F.count(F.lit(1)) == 1, F.first("correct"))
    )
    return wide.withColumn("step", F.col("checkpoint") + offset).orderBy("checkpoint")


def report_order(runs: DataFrame) -> DataFrame:
    return runs.orderBy("db_name", "query_category", "question")
