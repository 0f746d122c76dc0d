"""A whole benchmark in one call: from a question file to the written report and the stored run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.prompts import render_prompts
from assayer.operators.capture import number_rows
from assayer.operators.metrics import category_report
from assayer.plans.evaluate import RunOptions, evaluate_run
from assayer.plans.execute import generate
from assayer.session import materialise
from assayer.sources.questions import QUESTION_FIELDS, read_questions, with_metric_columns, with_optional_texts
from assayer.sources.results import write_results
from assayer.sources.store import append_run, insert_prompts

ANSWER_FIELDS = "qid BIGINT, content STRING, latency_seconds DOUBLE, tokens_used BIGINT"


@dataclass(frozen=True)
class Benchmark:
    """Where the questions come from, how answers are made and where everything goes.

    ``answers`` is a table of recorded answers by ``qid`` (the place of the question
    in its file, from 0) or a generator over batches of (qid, prompt) that runs in
    the tasks. ``parameters`` names at least the ``run_id``.
    """

    questions: str
    databases: str | dict[str, str] | None
    answers: DataFrame | Callable
    result_path: str
    eval_path: str
    prompt_path: str
    parameters: dict
    prompt_id: str = "prompt"
    template: str = "{question}\n{instructions}"
    db_type: str = "spark"
    schema: str = QUESTION_FIELDS
    first: int | None = None
    options: RunOptions = field(default_factory=RunOptions)


def run_benchmark(spark: SparkSession, plan: Benchmark) -> DataFrame:
    """Read, prompt, answer, score, write and store; the report by category.

    The scored rows are pinned once: the result file, the store and the report are
    made from the same rows.
    """
    read = read_questions(spark, plan.questions, plan.schema, plan.first)
    asked = with_optional_texts(with_metric_columns(number_rows(read, into="qid"), plan.db_type))
    values = {c: F.col(c) for c in asked.columns}
    prompted = materialise(render_prompts(asked, {plan.prompt_id: plan.template}, values).withColumnRenamed("template", "prompt_id"))
    answers = plan.answers
    if not isinstance(answers, DataFrame):
        answers = generate(prompted.select("qid", "prompt"), answers, ANSWER_FIELDS)
    run = materialise(evaluate_run(spark, prompted, answers, plan.databases, plan.options))
    write_results(run, plan.result_path)
    append_run(run, plan.eval_path, plan.parameters)
    texts = run.select(F.concat_ws(":", "prompt_id", F.sha2("prompt", 256)).alias("prompt_id"), "prompt")
    insert_prompts(spark, texts, plan.prompt_path, run=plan.parameters["run_id"])
    return category_report(run, with_count=True)
