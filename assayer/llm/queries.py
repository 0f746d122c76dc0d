"""One query for each operator over its whole table, with production parameters, and SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import byte_bpe, chat, collocations, decontaminate, exact_dedup, jaccard_join, licenses, mixing, mixture, repair, substring_dedup, token_counts, toxicity
from assayer.llm.common import documents, in_fold
from assayer.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir)).withColumnRenamed("digest", "text_sha256")


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scored(documents(spark, sf_dir), in_fold(F.col("doc_id"), 7, 2))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), in_fold(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.scored(docs, model).select("row.doc_id", "score", "predicted").withColumn("held_out", held_out)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.encode_and_decode(documents(spark, sf_dir), ranks, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op7_chat_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_texts(table(spark, sf_dir, "conversations"))


OP7_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations GROUP BY ALL
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS rendered
  FROM turns GROUP BY conv_id
), single AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS copies, rendered FROM whole GROUP BY n_turns, rendered
)
SELECT * FROM single s WHERE NOT EXISTS (
  SELECT 1 FROM single l WHERE l.n_turns > s.n_turns AND starts_with(l.rendered, s.rendered))
"""


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_components(documents(spark, sf_dir), percent=85, width=4)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.kept_texts(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), counts AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM words, unnest([1, 2, 3]) lengths(k), unnest(range(1, len(w) - k + 2)) places(i) GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS p FROM counts WHERE k > 1 AND f >= 10
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, min({'score': 1000000 * CAST(c.a AS HUGEINT) * c.a // (CAST(l.f AS HUGEINT) * r.f), 'cut': i, 'l': l.f, 'r': r.f}) AS best
  FROM candidates c, unnest(range(1, c.k)) cuts(i)
  JOIN counts l ON l.lang = c.lang AND l.k = i AND l.phrase = array_to_string(c.p[1:i], ' ')
  JOIN counts r ON r.lang = c.lang AND r.k = c.k - i AND r.phrase = array_to_string(c.p[i + 1:c.k], ' ')
  GROUP BY ALL
), left_out AS (
  SELECT s.lang, s.phrase FROM candidates s JOIN candidates t ON s.lang = t.lang AND t.k = 3 AND s.k = 2
    AND s.phrase IN (array_to_string(t.p[1:2], ' '), array_to_string(t.p[2:3], ' ')) AND 100 * t.a >= 50 * s.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY best.score DESC, a DESC, phrase) AS rank, phrase, a,
       best.l AS l, best.r AS r, n, CAST(best.score AS BIGINT) AS score
FROM cuts JOIN totals USING (lang)
WHERE (lang, phrase) NOT IN (SELECT lang, phrase FROM left_out)
QUALIFY rank <= 2000
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(repair.damaged(table(spark, sf_dir, "conversations")), copies_col="copies")


# The same by a search from row to row over the four states instead of spans; crc32 is its shift register, bit by bit.
OP12_SQL = r"""
WITH RECURSIVE drawn AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), draws AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(8 * length(k)),
           lambda i: CAST((ascii(substr(k, CAST(i // 8 + 1 AS BIGINT), 1)) >> CAST(i % 8 AS INTEGER)) & 1 AS BIGINT))),
           lambda c, b: xor(c >> 1, 3988292384 * xor(c & 1, b)))) % 20 AS draw
  FROM drawn
), damaged AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
  FROM draws, unnest(range(CASE draw WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn, substr(role, 1, 1) AS said FROM damaged
), faults AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, lag(said) OVER (PARTITION BY conv_id ORDER BY rn) AS before
  FROM placed
), follows(p, said, q) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), inserts(p, q, n, more) AS (
  VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 1, 'user:' || chr(10)), (1, 2, 1, 'user:' || chr(10)),
         (2, 3, 1, 'assistant:' || chr(10)), (3, 2, 1, 'user:' || chr(10)),
         (0, 3, 2, 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 2, 'user:' || chr(10) || 'assistant:' || chr(10))
), edits AS (
  SELECT conv_id, rn, p, p AS q, 3 AS cost, 'D' AS edit, '' AS more FROM faults, range(4) states(p)
  UNION ALL
  SELECT conv_id, rn, p, q, CAST(cut AS INTEGER), 'K', role || ':' || text || chr(10) FROM faults JOIN follows USING (said) WHERE NOT blank AND NOT again
  UNION ALL
  SELECT conv_id, rn, p, q, 2 + CAST(cut AS INTEGER), 'R', CASE follows.said WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text || chr(10)
  FROM faults JOIN follows ON follows.said <> 's' WHERE NOT blank AND NOT again
), ids AS (
  SELECT conv_id, (SELECT count(*) FROM faults f WHERE f.conv_id IS NOT DISTINCT FROM c.conv_id) AS rows FROM conversations c GROUP BY conv_id
), paths AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS rn, 0 AS state, {'cost': 0, 'audit': '', 'lines': ''} AS best FROM ids
  UNION ALL
  SELECT a.conv_id, a.rn + 1, e.q, min({'cost': a.best.cost + 2 * i.n + e.cost, 'audit': a.best.audit || repeat('I', i.n) || e.edit, 'lines': a.best.lines || i.more || e.more})
  FROM paths a JOIN inserts i ON a.state = i.p
  JOIN edits e ON e.conv_id IS NOT DISTINCT FROM a.conv_id AND e.rn = a.rn + 1 AND e.p = i.q
  GROUP BY a.conv_id, a.rn, e.q
), whole AS (
  SELECT a.conv_id, min({'cost': a.best.cost + 2 * i.n, 'audit': a.best.audit || repeat('I', i.n), 'lines': a.best.lines || i.more}) AS best
  FROM paths a JOIN ids ON ids.conv_id IS NOT DISTINCT FROM a.conv_id AND ids.rows = a.rn JOIN inserts i ON a.state = i.p AND i.q IN (0, 3)
  GROUP BY a.conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated,
         count(*) FILTER (before || said NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
)
SELECT w.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(w.best.cost AS BIGINT) AS cost, w.best.audit AS audit,
       sha256(substr(w.best.lines, 1, length(w.best.lines) - 1)) AS repaired_sha256
FROM whole w LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id
"""


def op13_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.taken_words(mixture.mix(documents(spark, sf_dir)))


OP13_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, row_number() OVER () AS nr, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS draw,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) AS number,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM docs GROUP BY source
), budget AS (
  SELECT sum(s) AS t, sum(w) AS ws FROM sources
), levels AS (
  SELECT *, 3 * s * (ws - coalesce(sum(w) OVER before, 0)) <= w * (t - coalesce(sum(3 * s) OVER before, 0)) AS held
  FROM sources, budget
  WINDOW before AS (ORDER BY 6 * s / w, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), rest AS (
  SELECT any_value(t) - coalesce(sum(3 * s) FILTER (held), 0) AS b, any_value(ws) - coalesce(sum(w) FILTER (held), 0) AS ws FROM levels
), goals AS (
  SELECT source, number, s, CASE WHEN held THEN CAST(3 * s AS DOUBLE) ELSE CAST(b * w AS DOUBLE) / CAST(rest.ws AS DOUBLE) END AS target
  FROM levels, rest
), queues AS (
  SELECT doc_id, nr, size, number, s, target, CAST(floor(target + 0.5) AS BIGINT) AS quota,
         sum(size) OVER (PARTITION BY number ORDER BY draw, nr) AS upto
  FROM docs JOIN goals ON docs.source IS NOT DISTINCT FROM goals.source
), served AS (
  SELECT nr, number, pass, (pass * s + upto) / target AS finish, least(size, quota - (pass * s + upto - size)) AS served
  FROM queues, range(3) passes(pass) WHERE size > 0 AND pass * s + upto - size < quota
), merged AS (
  SELECT nr, served, sum(served) OVER (ORDER BY finish, number, pass, nr) AS place FROM served
), taken AS (
  SELECT nr, sum(greatest(0, least(served, t - place + served))) AS taken FROM merged, budget GROUP BY nr
)
SELECT doc_id, CAST(size AS BIGINT) AS size, s AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM queues LEFT JOIN taken USING (nr)
"""


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_context_mixing,
        op3_toxicity,
        op4_license_scan,
        op5_byte_bpe,
        op6_decontaminate,
        op7_chat_texts,
        op8_jaccard_join,
        op9_substring_dedup,
        op10_token_counts,
        op11_collocations,
        op12_conversation_repair,
        op13_mixture,
    )
}

ORACLES: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op7_chat_texts": OP7_SQL, "op11_collocations": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_mixture": OP13_SQL}
