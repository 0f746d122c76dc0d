"""Work that must not gather in one task when tables grow."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from assayer.functions import metadata as md
from assayer.functions import rewrite
from assayer.operators.pairwise import same_rows
from assayer.session import ROWS_A_TASK, spread
from assayer.sources.questions import read_questions

QUERIES = entry_point.queries()


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(
    "name",
    [
        "d19_whole_ddl",
        "d18_dialect_dispatch",
        "d8_known_references",
        "d9_statements_for_dataset",
        "q3_brace_subsets",
        "d14_table_aliases",
        "d15_alias_hints",
        "d7_tables_of_lists",
        "q4_group_by_slot",
        "d7_referenced_tables",
    ],
)
def test_long_work_per_row_is_dealt_over_tasks(spark, sf_dir, name):
    above, dealt, below = plan_of(QUERIES[name](spark, sf_dir)).partition("RepartitionByExpression")
    assert dealt and "lambdafunction" in above
    # Neither the work nor a filter made of it has gone down to the scan.
    assert "lambdafunction" not in below


def test_ddl_texts_are_made_once():
    text = F.upper(F.col("ddl"))
    for made in (
        md.ddl_without_schemas(text), md.with_schema_lines(text),
        *[rewrite.translate_ddl(text, d, F.lit("shop"), F.lit(1)) for d in rewrite.DIALECTS],
    ):
        assert str(made).count("upper(") == 1


def test_references_are_found_once(spark, sf_dir):
    plan = plan_of(QUERIES["d8_known_references"](spark, sf_dir))
    assert plan.count("regexp_extract_all") == 1


def write_files(spark, path, sizes):
    """Question files in the order of their names, with numbered questions that break over lines."""
    start = 0
    for i, size in enumerate(sizes):
        numbers = spark.range(start, start + size, 1, 1)
        rows = numbers.select(F.lit("db"), F.lit("c"), F.concat(F.lit("q\n"), F.col("id").cast("string")), F.lit("SELECT 1"))
        rows.toDF("db_name", "query_category", "question", "query").write.option("header", True).option("escape", '"').csv(f"{path}/{i}")
        start += size


@pytest.mark.parametrize("first", [0, 1, 2, 3, 6, 8, 20, 36, 37, 100])
def test_first_questions_of_files(spark, tmp_path, first):
    write_files(spark, str(tmp_path), (2, 1, 30, 0, 4))
    found = [row.question for row in read_questions(spark, f"{tmp_path}/*", first=first).collect()]
    assert found == [f"q\n{i}" for i in range(min(first, 37))]


def test_first_questions_are_not_gathered(spark, tmp_path):
    write_files(spark, str(tmp_path), (40, 40, 40))
    plan = plan_of(read_questions(spark, f"{tmp_path}/*", first=100))
    # Whole files are taken as they are; only rows of the last file are counted off.
    whole, counted = plan.split("GlobalLimit")
    assert "GlobalLimit 20" in plan and "Relation" in whole and "Relation" in counted


@pytest.mark.parametrize("name", ["s1_first_of_several_files", "s1_read_questions"])
def test_question_files_stay_small(spark, sf_dir, monkeypatch, name):
    paths, limits = [], []
    from assayer.checks import storage

    write = storage._write_questions
    monkeypatch.setattr(storage, "_write_questions", lambda rows, path: (paths.append(path), limits.append(plan_of(rows)), write(rows, path)))
    QUERIES[name](spark, sf_dir)
    assert paths and not any("Repartition 1, false" in plan for plan in limits)


def test_row_digests_are_dealt_before_they_are_gathered(spark):
    gold = spark.range(3000).select((F.col("id") % 2000).alias("k"), F.lit("x").alias("t")).repartition(8, "t")
    plan = plan_of(same_rows(gold, gold, ["k", "t"], ["k", "t"]))
    assert "RepartitionByExpression [d0" in plan


@pytest.mark.parametrize("extra, same", [(0, True), (1, False)])
def test_frequent_and_rare_rows_are_compared(spark, extra, same):
    # One row makes up half of each frame, the others come once; the frames differ in a rare or a frequent row.
    frame = spark.range(4000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("k"))
    rare = frame.unionByName(spark.range(extra).select((F.col("id") + 9000).alias("k")))
    frequent = frame.unionByName(spark.range(extra * 3000).select(F.lit(-7).cast("bigint").alias("k")))
    for other in (rare, frequent):
        assert same_rows(frame, other, ["k"], ["k"]).first().same is same
        assert same_rows(other, frame, ["k"], ["k"]).first().same is same


def test_alternatives_are_grouped_where_they_are_made(spark, sf_dir):
    plan = QUERIES["q4_group_by_slot"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_more_rows_are_dealt_to_more_tasks(spark):
    rows = spark.range(10)
    few, many = spread(rows, "id", rows=10), spread(rows, "id", rows=100 * ROWS_A_TASK + 1)
    assert few.rdd.getNumPartitions() == spread(rows, "id").rdd.getNumPartitions()
    assert many.rdd.getNumPartitions() == 101
