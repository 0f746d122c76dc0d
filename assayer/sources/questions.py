"""Question tables: reading, default metric columns, optional text columns."""

from __future__ import annotations

from itertools import repeat

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.functions.metadata import alias_hint
from assayer.functions.textops import swap

# The sentences around optional texts and the mode names.
K_SHOT_HEAD = "Adhere closely to the following correct examples as references for answering the question:\n"
INSTRUCTION_HEAD = "\nFollow the instructions below to generate the query:\n"
GLOSSARY_HEAD = (
    "\nCarefully follow these instructions if and only if they are relevant to the question and the query you generate:\n"
)
COT_INSTRUCTION = (
    "List the table aliases for each table as comments, starting with the most relevant tables to the question."
)
PLAIN_TEXTS = [
    "table_metadata_string", "prev_invalid_sql", "prev_error_msg", "question_0", "query_0", "question_1", "query_1"
]
QUESTION_FIELDS = "db_name STRING, query_category STRING, question STRING, query STRING"


def read_questions(spark: SparkSession, path: str, schema: str = QUESTION_FIELDS, first: int | None = None) -> DataFrame:
    """Read a question CSV with a declared schema, optionally only its first rows.

    The rows of a folder come file by file in the order of the names, whatever
    order the files are read in; a file of lines that break is read as a whole,
    so its rows keep their places. Which files are wanted follows from their row
    counts, and only of the last one are rows counted off.
    """
    rows = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)
    )
    if first is None:
        return rows
    filed = rows.withColumn("_file", F.col("_metadata.file_path"))
    # One row per file.
    sizes = filed.groupBy("_file").agg(F.count(F.lit(1)).alias("n"))
    ends = sizes.withColumn("end", F.sum("n").over(Window.orderBy("_file")))
    last = ends.where(F.col("end") >= first).orderBy("_file").first()
    if last is not None:
        whole, begun = filed.where(F.col("_file") < last["_file"]), filed.where(F.col("_file") == last["_file"])
        filed = whole.unionByName(begun.limit(first - (last["end"] - last["n"])))
    return filed.withColumn("_place", F.monotonically_increasing_id()).orderBy("_file", "_place").drop("_file", "_place")


def paired(questions: list[str], prompts: list[str], outputs: list[str]) -> list[tuple[str, str, str]]:
    """Question, prompt and output files side by side; a lone entry serves all."""
    wanted = max(len(questions), len(prompts), len(outputs))
    lists = []
    for name, files in (("questions", questions), ("prompts", prompts), ("outputs", outputs)):
        if len(files) not in (1, wanted):
            raise ValueError(f"{len(files)} {name} files do not pair with {wanted}")
        lists.append(files if len(files) == wanted else list(repeat(files[0], wanted)))
    return list(zip(*lists))


def with_metric_columns(questions: DataFrame, db_type: str) -> DataFrame:
    """The columns an evaluated run fills in, with their start values."""
    texts = {c: F.lit("") for c in ("generated_query", "reason", "error_msg")}
    flags = {c: F.lit(0) for c in ("exact_match", "correct", "error_query_gen", "error_db_exec", "timeout")}
    numbers = {"latency_seconds": F.lit(0.0), "tokens_used": F.lit(0).cast("bigint")}
    return questions.withColumns({"db_type": F.lit(db_type), **texts, **flags, **numbers})


def with_optional_texts(questions: DataFrame, k_shot: bool = False) -> DataFrame:
    """Bring optional text columns into the form the prompts expect."""

    def present(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    def head(text: str, body: Column, tail: str = "") -> Column:
        return F.concat(F.lit(text), body, F.lit(tail))

    columns = {}
    if "instructions" in questions.columns:
        lines = swap(present("instructions"), ". ", ".\n")
        columns["instructions"] = F.when(lines != "", head(INSTRUCTION_HEAD, lines, "\n")).otherwise("")
    else:
        columns["instructions"] = F.lit("")
    if not k_shot:
        columns["k_shot_prompt"] = F.lit("")
    elif "k_shot_prompt" not in questions.columns:
        raise ValueError("k_shot needs the column k_shot_prompt")
    else:
        columns["k_shot_prompt"] = head(K_SHOT_HEAD, swap(present("k_shot_prompt"), "\\n", "\n"))
    if "glossary" in questions.columns:
        columns["glossary"] = head(GLOSSARY_HEAD, present("glossary"), "\n")
    else:
        columns["glossary"] = F.lit("")
    for name in PLAIN_TEXTS:
        columns[name] = present(name) if name in questions.columns else F.lit("")
    return questions.withColumns(columns)


def with_cot_mode(questions: DataFrame, mode: str = "") -> DataFrame:
    """Chain-of-thought columns: an instruction text, a pre-generation flag, or neither."""
    return questions.withColumns(
        {
            "cot_instructions": F.lit(COT_INSTRUCTION if mode == "instruct" else ""),
            "cot_pregen": F.lit(mode == "pregen"),
        }
    )


def with_table_aliases(questions: DataFrame, tables: DataFrame) -> DataFrame:
    """Attach the alias hint of the question's database; ``tables`` has (db_name, names)."""
    hints = tables.select("db_name", alias_hint(F.col("names")).alias("table_aliases"))
    return questions.join(hints, "db_name", "left")


def prepare_questions(
    questions: DataFrame, db_type: str, k_shot: bool = False, cot_mode: str = "", tables: DataFrame | None = None
) -> DataFrame:
    """All preparation steps of a question table."""
    prepared = with_cot_mode(with_optional_texts(with_metric_columns(questions, db_type), k_shot), cot_mode)
    return with_table_aliases(prepared, tables) if tables is not None else prepared
