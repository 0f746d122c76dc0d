"""Clean-up of generated SQL text, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.ordered import attach
from assayer.session import materialise

# Code fences, answer markers and the texts the fix-ups replace.
SQL_FENCE = "```sql"
FENCE = "```"
SQL_MARK = "[SQL]"
THINK_END = "</think>"
OPERATOR_FIXES = [("< =", "<="), ("> =", ">="), ("/ NULLIF (", "/ NULLIF (1.0 * ")]

_SPACE = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(F.regexp_replace(text, f"(?U)^{_SPACE}+", ""), f"(?U){_SPACE}+\\z", "")


def swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def after_first(text: Column, mark: str) -> Column:
    """What follows the first mark, or the whole text without one."""
    place = F.instr(text, F.lit(mark))
    return F.when(place > 0, F.substring(text, place + F.lit(len(mark)), F.length(text))).otherwise(text)


def before_first(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def after_last(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, -1)


def first_fenced(content: Column) -> Column:
    """Text after the first SQL fence up to the next fence."""
    return strip(before_first(after_first(content, SQL_FENCE), FENCE))


def last_fenced_statement(content: Column) -> Column:
    """First statement after the last SQL fence, closed with one semicolon."""
    body = before_first(before_first(after_last(content, SQL_FENCE), FENCE), ";")
    return F.concat(strip(body), F.lit(";"))


def unescaped_statement(content: Column) -> Column:
    """First statement without back-slashes and fences; the raw text if none is left."""
    head = strip(after_last(before_first(swap(content, "\\", ""), ";"), SQL_FENCE))
    parts = F.filter(F.split(head, FENCE), lambda p: strip(p) != "")
    return F.coalesce(F.concat(F.get(parts, F.lit(0)), F.lit(";")), content)


def before_fence(content: Column) -> Column:
    return strip(before_first(content, FENCE))


def without_fences(content: Column) -> Column:
    return strip(swap(swap(content, SQL_FENCE, ""), FENCE, ""))


def response_content(body: Column) -> Column:
    """The answer text of a JSON response in any of the known layouts."""
    layouts = ("$.choices[0].message.content", "$.text[0]", "$.generated_text")
    return F.coalesce(*[F.get_json_object(body, path) for path in layouts], F.lit(""))


def marked_answer(content: Column) -> Column:
    """What follows the SQL mark, else the end of the reasoning, else everything."""
    marked = F.contains(content, F.lit(SQL_MARK))
    return strip(F.when(marked, after_first(content, SQL_MARK)).otherwise(after_first(content, THINK_END)))


def tidy_statement(sql: Column) -> Column:
    """Mend split operators, force float denominators, close up brackets."""
    for old, new in OPERATOR_FIXES:
        sql = swap(sql, old, new)
    sql = F.regexp_replace(sql, r"(?U)\s*\(\s*", "(")
    return F.regexp_replace(sql, r"(?U)\s*\)", ")")


def parsed_answer(content: Column) -> Column:
    """``struct<reason, sql>`` of a JSON answer; fields are NULL if it is none."""
    return F.from_json(content, "reason STRING, sql STRING")


CLEANERS = {
    "first_fence": first_fenced,
    "last_fence": last_fenced_statement,
    "unescape": unescaped_statement,
    "before_fence": before_fence,
    "drop_fences": without_fences,
    "marked": lambda body: tidy_statement(marked_answer(response_content(body))),
    "raw": lambda content: content,
}


def token_probabilities(logprobs: Column) -> Column:
    """Per token one flat map: ``rank_k_token/logprob/prob`` and ``prob_diff``.

    ``logprobs`` is an array of maps token id -> struct(rank, logprob,
    decoded_token). Probabilities are powers of ten, as the scores define them.
    """

    def fields(entry: Column) -> Column:
        rank = F.concat(F.lit("rank_"), entry["rank"].cast("string"))
        prob = F.pow(F.lit(10.0), entry["logprob"])

        def field(suffix: str, value: Column) -> Column:
            return F.struct(F.concat(rank, F.lit(suffix)).alias("k"), value.cast("string").alias("v"))

        return F.array(
            field("_token", entry["decoded_token"]), field("_logprob", entry["logprob"]), field("_prob", prob)
        )

    def flat(token: Column) -> Column:
        listed = F.map_values(token)
        # Of two entries with one rank the later one counts.
        entries = F.filter(
            listed,
            lambda e, i: ~F.exists(F.slice(listed, i + 2, F.size(listed)), lambda later: later["rank"] == e["rank"]),
        )
        record = F.map_from_entries(F.flatten(F.transform(entries, fields)))

        def prob(rank: int) -> Column:
            found = F.filter(entries, lambda e: e["rank"] == rank)
            return F.pow(F.lit(10.0), F.get(found, F.lit(0))["logprob"])

        diff = F.map_from_arrays(F.array(F.lit("prob_diff")), F.array((prob(1) - prob(2)).cast("string")))
        return F.map_concat(record, diff)

    return F.transform(logprobs, flat)


def with_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Add ``priced_as`` and ``cost_in_cents`` from a price table.

    A model is priced by its exact name, else by the longest listed name its own
    name contains; without any the cost is NULL. Names are matched once per
    distinct model, and the measured result goes to the calls, which are not
    shuffled for it.
    """
    models = calls.select("model").distinct()
    listed = prices.select(F.col("model").alias("priced_as"), "input_cost_per1k", "output_cost_per1k")
    rank = F.struct(F.length("priced_as"), F.col("priced_as"))
    best = materialise(
        models.join(listed, F.expr("contains(model, priced_as)"))
        .groupBy("model")
        .agg(F.max_by(F.struct("priced_as", "input_cost_per1k", "output_cost_per1k"), rank).alias("price"))
        .select("model", "price.*")
    )
    cents = (
        F.col("input_tokens") / 1000 * F.col("input_cost_per1k")
        + F.col("output_tokens") / 1000 * F.col("output_cost_per1k")
    ) * 100
    priced = attach(calls, best, ["model"], by=["input_tokens", "output_tokens"], how="left")
    return priced.withColumn("cost_in_cents", cents).drop("input_cost_per1k", "output_cost_per1k")


def with_usage(calls: DataFrame) -> DataFrame:
    """Tokens used and seconds taken per call."""
    micros = F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("finished_at"))
    return calls.withColumn("tokens_used", F.col("input_tokens") + F.col("output_tokens")).withColumn(
        "latency_seconds", micros / F.lit(1_000_000.0)
    )


# US dollars per 1,000 tokens, input and output.
MODEL_PRICES = [
    ("gpt-4o", 0.0025, 0.01),
    ("gpt-4o-mini", 0.00015, 0.0006),
    ("o1", 0.015, 0.06),
    ("o1-preview", 0.015, 0.06),
    ("o1-mini", 0.003, 0.012),
    ("o3-mini", 0.0011, 0.0044),
    ("gpt-4-turbo", 0.01, 0.03),
    ("gpt-3.5-turbo", 0.0005, 0.0015),
    ("claude-3-5-sonnet", 0.003, 0.015),
    ("claude-3-5-haiku", 0.00025, 0.00125),
    ("claude-3-opus", 0.015, 0.075),
    ("claude-3-sonnet", 0.003, 0.015),
    ("claude-3-haiku", 0.00025, 0.00125),
    ("gemini-1.5-pro", 0.00125, 0.005),
    ("gemini-1.5-flash", 0.000075, 0.0003),
    ("gemini-1.5-flash-8b", 0.0000375, 0.00015),
    ("gemini-2.0-flash", 0.000075, 0.0003),
]


def price_table(spark) -> DataFrame:
    return spark.createDataFrame(
        MODEL_PRICES, "model string, input_cost_per1k double, output_cost_per1k double"
    )
