"""Checks of the clean-up of generated text, prices and token probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.checks import check
from assayer.functions import textops as tx
from assayer.session import table

# Six ways an answer wraps its statement, by conversation.
CONTENT_SQL = """
SELECT conv_id, turn, role, text,
       CASE conv_id % 6
            WHEN 0 THEN concat('Here it is:', chr(10), '```sql', chr(10), 'SELECT ', text, ';', chr(10), '```', chr(10), 'done')
            WHEN 1 THEN concat('```sql SELECT 1; ``` then ```sql ', text, ' ; x``` end')
            WHEN 2 THEN concat('thinking </think>  ', text)
            WHEN 3 THEN concat('[SQL] ', text, '; [/SQL] </think> rest')
            WHEN 4 THEN concat('```', chr(10), 'SELECT a', chr(92), '_b < = 3 AND c / NULLIF (d, 0) > ( 2 ) ', text, '```')
            ELSE concat(chr(9), ' ', text, ' ', chr(10)) END AS content
FROM conversations
"""


def contents(spark, sf_dir):
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    return spark.sql(CONTENT_SQL)


def _strip(x: str) -> str:
    """DuckDB text of a strip of white space on both ends."""
    space = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"
    return f"regexp_replace(regexp_replace({x}, '^{space}', ''), '{space}$', '')"


def _after(x: str, mark: str) -> str:
    return f"CASE WHEN instr({x}, '{mark}') > 0 THEN substr({x}, instr({x}, '{mark}') + {len(mark)}) ELSE {x} END"


def _oracle(expr: str) -> str:
    return f"WITH c AS ({CONTENT_SQL}) SELECT conv_id, turn, {expr} AS sql FROM c"


def _cleaned(name, expr, fn):
    @check(name, _oracle(expr))
    def run(spark, sf_dir):
        return contents(spark, sf_dir).select("conv_id", "turn", fn(F.col("content")).alias("sql"))

    return run


_cleaned("t1_first_fenced", _strip(f"split_part({_after('content', '```sql')}, '```', 1)"), tx.first_fenced)
_cleaned(
    "t2_last_fenced_statement",
    "concat(" + _strip("split_part(split_part(string_split(content, '```sql')[-1], '```', 1), ';', 1)") + ", ';')",
    tx.last_fenced_statement,
)
_HEAD = _strip("string_split(split_part(replace(content, chr(92), ''), ';', 1), '```sql')[-1]")
_PARTS = f"list_filter(string_split({_HEAD}, '```'), lambda p: {_strip('p')} <> '')"
_cleaned("t3_unescaped_statement", f"coalesce({_PARTS}[1] || ';', content)", tx.unescaped_statement)
_cleaned("t4_before_fence", _strip("split_part(content, '```', 1)"), tx.before_fence)
_cleaned("t5_without_fences", _strip("replace(replace(content, '```sql', ''), '```', '')"), tx.without_fences)


@check(
    "t6_response_layouts",
    f"""
WITH c AS ({CONTENT_SQL}),
b AS (SELECT conv_id, turn, CASE turn % 4
        WHEN 0 THEN CAST(json_object('choices', [json_object('message', json_object('role', role, 'content', content))]) AS VARCHAR)
        WHEN 1 THEN CAST(json_object('text', [content, 'second']) AS VARCHAR)
        WHEN 2 THEN CAST(json_object('generated_text', content) AS VARCHAR)
        ELSE CAST(json_object('detail', content) AS VARCHAR) END AS body FROM c),
p AS (SELECT conv_id, turn, coalesce(json_extract_string(body, '$.choices[0].message.content'),
        json_extract_string(body, '$.text[0]'), json_extract_string(body, '$.generated_text'), '') AS content FROM b)
SELECT conv_id, turn, {_strip("CASE WHEN contains(content, '[SQL]') THEN " + _after('content', '[SQL]') + " ELSE " + _after('content', '</think>') + " END")} AS answer FROM p
""",
)
def response_layouts(spark, sf_dir):
    c = F.col("content")
    body = (
        F.when(
            F.col("turn") % 4 == 0,
            F.to_json(
                F.struct(
                    F.array(F.struct(F.struct("role", c.alias("content")).alias("message"))).alias("choices")
                )
            ),
        )
        .when(F.col("turn") % 4 == 1, F.to_json(F.struct(F.array(c, F.lit("second")).alias("text"))))
        .when(F.col("turn") % 4 == 2, F.to_json(F.struct(c.alias("generated_text"))))
        .otherwise(F.to_json(F.struct(c.alias("detail"))))
    )
    bodies = contents(spark, sf_dir).select("conv_id", "turn", body.alias("body"))
    return bodies.select(
        "conv_id", "turn", tx.marked_answer(tx.response_content(F.col("body"))).alias("answer")
    )


_FIXED = "replace(replace(replace(content, '< =', '<='), '> =', '>='), '/ NULLIF (', '/ NULLIF (1.0 * ')"
_SP = r"[\s\x{0b}\x{85}\p{Z}]*"
_cleaned(
    "t7_tidy_statement",
    rf"regexp_replace(regexp_replace({_FIXED}, '{_SP}\({_SP}', '(', 'g'), '{_SP}\)', ')', 'g')",
    tx.tidy_statement,
)


@check(
    "t8_json_answer",
    """
SELECT conv_id, turn, CASE WHEN conv_id % 5 <> 0 THEN role END AS reason, CASE WHEN conv_id % 5 > 1 THEN text END AS sql
FROM conversations
""",
)
def json_answer(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    answer = (
        F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit('{"reason": '), "text"))
        .when(F.col("conv_id") % 5 == 1, F.to_json(F.struct(F.col("role").alias("reason"))))
        .otherwise(F.to_json(F.struct(F.col("role").alias("reason"), F.col("text").alias("sql"))))
    )
    parsed = talk.select("conv_id", "turn", tx.parsed_answer(answer).alias("a"))
    return parsed.select("conv_id", "turn", "a.reason", "a.sql")


@check(
    "t9_token_probabilities",
    """
WITH e AS (SELECT vec_id, unnest(generate_series(0, 31)) AS token, embedding FROM embeddings),
p AS (SELECT vec_id, token, -abs(CAST(embedding[2 * token + 1] AS DOUBLE)) AS lp1,
             -abs(CAST(embedding[2 * token + 2] AS DOUBLE)) - 0.25 AS lp2 FROM e)
SELECT vec_id, token::BIGINT AS token, concat('a', token) AS rank_1_token, concat('b', token) AS rank_2_token,
       round(pow(10.0, lp1), 9) AS rank_1_prob, round(pow(10.0, lp2), 9) AS rank_2_prob,
       round(lp1, 9) AS rank_1_logprob, round(pow(10.0, lp1) - pow(10.0, lp2), 9) AS prob_diff
FROM p
""",
)
def token_probabilities(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")

    def token(i):
        def entry(rank, place, shift, prefix):
            score = -F.abs(F.get("embedding", i * 2 + place).cast("double")) - F.lit(shift)
            return F.struct(
                F.lit(rank).alias("rank"),
                score.alias("logprob"),
                F.concat(F.lit(prefix), i.cast("string")).alias("decoded_token"),
            )

        return F.map_from_arrays(
            F.array(F.lit("1"), F.lit("2")), F.array(entry(1, 0, 0.0, "a"), entry(2, 1, 0.25, "b"))
        )

    scores = vectors.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(31)), token).alias("logprobs"))
    flat = scores.select("vec_id", F.posexplode(tx.token_probabilities(F.col("logprobs"))).alias("token", "m"))

    def number(key):
        return F.round(F.col("m")[key].cast("double"), 9).alias(key)

    return flat.select(
        "vec_id",
        F.col("token").cast("bigint").alias("token"),
        F.col("m")["rank_1_token"].alias("rank_1_token"),
        F.col("m")["rank_2_token"].alias("rank_2_token"),
        number("rank_1_prob"),
        number("rank_2_prob"),
        number("rank_1_logprob"),
        number("prob_diff"),
    )


CALLS_SQL = """
SELECT o_orderkey AS call_id, o_custkey,
       CASE o_orderkey % 9 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini-2024-07-18' WHEN 2 THEN 'o1-preview'
            WHEN 3 THEN 'models/gemini-1.5-flash-8b-001' WHEN 4 THEN 'gemini-1.5-flash-002' WHEN 5 THEN 'o1-mini-x'
            WHEN 6 THEN 'claude-3-5-haiku-latest' WHEN 7 THEN 'some-other-model' ELSE 'gpt-3.5-turbo-16k' END AS model,
       CAST(floor(o_totalprice / 100) AS BIGINT) AS input_tokens, CAST(o_custkey % 700 AS BIGINT) AS output_tokens
FROM orders
"""
_PRICES = ", ".join(f"('{m}', {i}, {o})" for m, i, o in tx.MODEL_PRICES)


@check(
    "t10_model_cost",
    f"""
WITH calls AS ({CALLS_SQL}),
prices(name, i, o) AS (VALUES {_PRICES}),
best AS (SELECT call_id, model, input_tokens, output_tokens, name, i, o,
                row_number() OVER (PARTITION BY call_id ORDER BY length(name) DESC NULLS LAST) AS rn
         FROM calls LEFT JOIN prices ON contains(model, name))
SELECT call_id, name AS priced_as,
       round((input_tokens / 1000 * CAST(i AS DOUBLE) + output_tokens / 1000 * CAST(o AS DOUBLE)) * 100, 9) AS cost_in_cents
FROM best WHERE rn = 1
""",
)
def model_cost(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    priced = tx.with_cost(spark.sql(CALLS_SQL), tx.price_table(spark))
    return priced.select("call_id", "priced_as", F.round("cost_in_cents", 9).alias("cost_in_cents"))


_USAGE_SQL = """
SELECT call_id, model, input_tokens, output_tokens, started_at,
       started_at + (input_tokens * 7 + output_tokens) * INTERVAL '1' SECOND AS finished_at
FROM (SELECT c.*, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS started_at FROM calls c)
"""


@check(
    "t11_usage",
    f"""
SELECT call_id, input_tokens + output_tokens AS tokens_used,
       CAST(input_tokens * 7 + output_tokens AS DOUBLE) AS latency_seconds FROM ({CALLS_SQL})
""",
)
def usage(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    calls = spark.sql(CALLS_SQL)
    calls.createOrReplaceTempView("calls")
    timed = spark.sql(_USAGE_SQL)
    return tx.with_usage(timed).select("call_id", "tokens_used", "latency_seconds")
