"""Turning verdicts and errors into the metric columns of an evaluated run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The texts and prefixes of ``error_msg``.
GENERATION_ERROR = "GENERATION ERROR: "
EXECUTION_ERROR = "EXECUTION ERROR: "
QUERY_EXECUTION_ERROR = "QUERY EXECUTION ERROR: "
API_TIMEOUT = "API TIMEOUT"
INCORRECT = "INCORRECT RESULTS"


def outcome_columns(
    df: DataFrame,
    execution_prefix: str = EXECUTION_ERROR,
    mark_incorrect: bool = True,
    legacy_flags: bool = False,
) -> DataFrame:
    """Add exact_match, correct, the error flags, ``error_class`` and ``error_msg``.

    Reads ``exact, correct, error, generation_error, timed_out``. A failed
    generation sets ``error_query_gen``; with ``legacy_flags`` it sets
    ``error_db_exec`` instead, as some runners record it.
    """
    late = F.coalesce("timed_out", F.lit(False))
    unmade = ~late & F.col("generation_error").isNotNull()
    broken = ~late & ~unmade & F.col("error").isNotNull()
    ran = ~late & ~unmade & ~broken
    right = ran & F.coalesce("correct", F.lit(False))
    exact = ran & F.coalesce("exact", F.lit(False))
    wrong = ran & ~right
    no_query = late | unmade

    def flag(condition):
        return F.when(condition, 1).otherwise(0)

    kind = (
        F.when(late, "timeout")
        .when(unmade, "generation")
        .when(broken, "execution")
        .when(wrong, "incorrect")
        .otherwise("")
    )
    message = (
        F.when(late, F.lit(API_TIMEOUT))
        .when(unmade, F.concat(F.lit(GENERATION_ERROR), "generation_error"))
        .when(broken, F.concat(F.lit(execution_prefix), "error"))
        .when(wrong & F.lit(mark_incorrect), F.lit(INCORRECT))
        .otherwise("")
    )
    return df.withColumns(
        {
            "exact_match": flag(exact),
            "correct": flag(right),
            "error_query_gen": flag(no_query & F.lit(not legacy_flags)),
            "error_db_exec": flag(broken | (no_query & F.lit(legacy_flags))),
            "timeout": flag(late),
            "error_class": kind,
            "error_msg": message,
        }
    )
