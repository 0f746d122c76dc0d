"""Does a question ask for an order, and which order does a statement state?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The category and the words that announce an ordering intent,
# the words of an ORDER BY clause that are not column names, and the pattern
# that takes the first sort key out of the clause.
ORDER_CATEGORY = "order_by"
INTENT_PATTERN = r"(?iU)\b(order|sort|arrange)\b"
CLAUSE_WORDS = ["desc", "asc", "nulls", "last", "first", "limit"]
SORT_KEY_PATTERN = r"(?id)(?<=ORDER BY)(.*?)(?=;|,|\)|$)"

ORDER_TYPE = "struct<stated:boolean,keys:array<string>,descending:boolean>"


def wants_order(category: Column, question: Column) -> Column:
    """True when the category is the ordering one or the question names an order."""
    asked = F.coalesce(F.lower(question).rlike(INTENT_PATTERN), F.lit(False))
    return F.coalesce(category == ORDER_CATEGORY, F.lit(False)) | asked


def stated_order(sql: Column, robust: bool = False) -> Column:
    """Sort key names and direction of the first ORDER BY, as a struct.

    ``stated`` is false without an ORDER BY. Without a readable direction the
    order counts as descending. The faithful reading stops at a line break and
    then finds no key; ``robust`` folds white space first and takes a missing
    direction as ascending.
    """
    text = F.regexp_replace(sql, r"\s+", " ") if robust else sql
    tail = F.regexp_extract(text, r"(?is)ORDER BY.*", 0)
    key_text = F.regexp_extract(tail, SORT_KEY_PATTERN, 1)
    tokens = F.transform(
        F.filter(F.split(key_text, r"\s+"), lambda t: t != ""),
        lambda t: F.substring_index(t, ".", -1),
    )
    upper = F.transform(tokens, F.upper)
    falls = F.array_contains(upper, "DESC")
    if not robust:
        falls = falls | ~F.array_contains(upper, "ASC")
    names = F.transform(tokens, lambda t: F.replace(F.replace(t, F.lit(","), F.lit("")), F.lit("("), F.lit("")))
    words = F.array(*[F.lit(w) for w in CLAUSE_WORDS])
    keys = F.filter(names, lambda t: ~F.array_contains(words, F.lower(t)))
    stated = F.coalesce(F.length(tail) > 0, F.lit(False))
    return F.struct(
        stated.alias("stated"),
        F.coalesce(keys, F.array().cast("array<string>")).alias("keys"),
        F.coalesce(falls, F.lit(True)).alias("descending"),
    )
