"""The run store: evaluated rows and the prompts they used."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the stored tables.
EVAL_FIELDS = (
    "run_id STRING, created_at TIMESTAMP, runner_type STRING, prompt_id STRING, model STRING, num_beams INT, "
    "db_type STRING, gpu_name STRING, gpu_memory STRING, gpu_driver_version STRING, gpu_cuda_version STRING, "
    "num_gpus STRING, question STRING, golden_query STRING, db_name STRING, query_category STRING, "
    "generated_query STRING, error_msg STRING, exact_match BOOLEAN, correct BOOLEAN, error_db_exec BOOLEAN, "
    "latency_seconds DOUBLE, tokens_used INT"
)
PROMPT_FIELDS = "prompt_id STRING, prompt STRING"
RUN_PARAMETERS = [
    "run_id", "created_at", "runner_type", "prompt_id", "model", "num_beams", "db_type", "gpu_name", "gpu_memory",
    "gpu_driver_version", "gpu_cuda_version", "num_gpus",
]


def stamp() -> dict[str, str]:
    """A new run id and the present time."""
    return {"run_id": uuid.uuid4().hex, "created_at": datetime.now(timezone.utc).isoformat(timespec="seconds")}


def store_rows(results: DataFrame, parameters: dict) -> DataFrame:
    """Result rows in the shape of the store, with the constants of their run."""
    named = results.withColumnRenamed("query", "golden_query")
    constants = {c: F.lit(parameters.get(c)) for c in RUN_PARAMETERS if c in parameters or c not in named.columns}
    full = named.withColumns(constants)
    fields = [f.strip().split(" ") for f in EVAL_FIELDS.split(",")]
    missing = {n: F.lit(None) for n, _ in fields if n not in full.columns}
    return full.withColumns(missing).select(*[F.col(n).cast(t).alias(n) for n, t in fields])


def nested_rows(results: DataFrame, parameters: dict) -> DataFrame:
    """Result rows with the run time and all parameters of their run in one column."""
    params = F.struct(*[F.lit(parameters.get(c)).alias(c) for c in RUN_PARAMETERS if c != "created_at"])
    return results.withColumn("run_time", F.lit(parameters.get("created_at")).cast("timestamp")).withColumn("run_params", params)


def batch_path(path: str, run: str, batch: int) -> str:
    """Where one batch of one run is stored; runs never share a folder."""
    return f"{path}/run={quote(run, safe='')}/batch={batch}"


def create_store(spark: SparkSession, eval_path: str, prompt_path: str) -> None:
    """Empty tables, so that the first append finds a schema."""
    for path, fields in ((eval_path, EVAL_FIELDS), (prompt_path, PROMPT_FIELDS)):
        spark.createDataFrame([], fields).write.mode("ignore").parquet(batch_path(path, "none", -1))


def append_run(results: DataFrame, path: str, parameters: dict, batch: int = 0) -> None:
    """Store one batch of a run; a batch that is there already is an error."""
    if not parameters.get("run_id"):
        raise ValueError("a run needs a run_id")
    store_rows(results, parameters).write.mode("errorifexists").parquet(batch_path(path, parameters["run_id"], batch))


def unseen_prompts(new: DataFrame, known: DataFrame) -> DataFrame:
    """New prompts whose id is not stored yet, one row per id."""
    once = new.groupBy("prompt_id").agg(F.min("prompt").alias("prompt"))
    return once.join(known.select("prompt_id"), "prompt_id", "left_anti")


def insert_prompts(spark: SparkSession, new: DataFrame, path: str, batch: int = 0, run: str = "prompts") -> None:
    """Append unseen prompts to a stored prompt table."""
    known = spark.read.schema(PROMPT_FIELDS).parquet(path)
    unseen_prompts(new, known).write.mode("append").parquet(batch_path(path, run, batch))
