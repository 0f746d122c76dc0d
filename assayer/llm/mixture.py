"""Mixing sources to target weights by weighted fair queueing.

Every document waits in the queue of its source, in a shuffled order that a hash
of its id and text decides; a source may pass its queue several times. Its virtual
finish time is what its source has been served with it, divided by the target of
the source. All queues are merged by one global range sort on that time. The
targets add up to the budget, so the budget is used up at virtual time one: what a
document would be served after that is cut off, and the running sum of the merged
queue is truncated at the budget.

Neither the order inside a source nor the merged order is ever a window over a
source: both are running sums over range slices.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import WORD_PATTERN, attached, pinned
from assayer.llm.running import running_sums


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


@dataclass
class Mixture:
    """``rows``: a row for each document (doc_id, at, size, source, source_size, target); ``items``: what the mix takes, see ``mix``."""

    rows: DataFrame
    items: DataFrame


def targets(sources: DataFrame, weights: Sequence[int], most: int, budget: int) -> DataFrame:
    """``sources`` (source_key, source, source_size, n) with number, before (size of the sources before), target and quota.

    Sources are numbered by code point, null last; source i weighs
    ``weights[i % len(weights)]``. The budget is shared by weight. No target is more
    than ``most`` times the size of its source: what is too much is shared again by
    weight among the others, until none is above. A source is held at its limit if its
    limit per weight is at most what the sources with larger ones can still get, so
    one pass in that order settles all. Sums and products are exact.
    """
    ordered = running_sums(sources.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], {"number": "one", "upto": "source_size"}, "mix-sources")
    which = F.expr("cast(number - 1 as long)") % len(weights)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (which + 1).cast("int"))
    weighed = ordered.withColumn("weight", weight).withColumns(
        {
            "before": F.col("upto") - F.col("source_size"),
            "limit": F.col("source_size") * most,
            "level": F.expr(f"source_size * {lcm(*weights)}L div weight"),
        }
    )
    total = weighed.agg(F.sum("weight")).first()[0] or 0
    by_level = running_sums(weighed, [F.col("level"), F.col("number")], {"limits": "limit", "weights": "weight"}, "mix-levels")
    exact = lambda c: c.cast("decimal(19,0)")
    left_weight = F.lit(total) - F.col("weights") + F.col("weight")
    left_budget = F.lit(budget) - F.col("limits") + F.col("limit")
    held = exact(F.col("limit")) * exact(left_weight) <= exact(F.col("weight")) * exact(left_budget)
    settled = pinned(by_level.withColumn("held", held), "mix-held")
    gone = settled.where("held").agg(F.sum("limit"), F.sum("weight")).first()
    rest, weight_of_rest = budget - (gone[0] or 0), total - (gone[1] or 0)
    share = (F.lit(rest).cast("long") * F.col("weight")).cast("double") / F.lit(float(weight_of_rest or 1))
    target = F.when(F.col("held"), F.col("limit").cast("double")).otherwise(share)
    return settled.select(
        "source_key", "number", "source_size", "before", "n", target.alias("target"), F.floor(target + 0.5).cast("long").alias("quota")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    most: int = 3,
    budget: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> Mixture:
    """Queue all documents and take what the budget (in words; as much as all documents have, unless given) allows.

    ``items`` has a row for each time a document is taken: at (the row), doc_id,
    source, pass (from 0), taken (words; all, but for the last document of a source
    and of the budget), finish (virtual time) and place (words of the mix up to its end).
    Every source gets its target, rounded to whole words, and no document is taken more
    than ``most`` times.

    Null texts and texts without words have size 0 and are never taken. A null source
    is a source of its own, the last. Null ids are ids like any other. Repeated rows
    count each and wait one behind the other. A table without words gives targets of 0.
    Extra columns are not looked at.
    """
    text, source = F.coalesce(F.col(text_col), F.lit("")), F.col(source_col).cast("string")
    rows = pinned(
        docs.select(
            F.col(id_col).alias("doc_id"),
            source.alias("source"),
            F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("source_key"),
            F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text).cast("binary")).alias("draw"),
            n_words(text).alias("size"),
            F.monotonically_increasing_id().alias("at"),
        ),
        "mix-rows",
    )
    sources = rows.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = pinned(sources, "mix-sizes")
    if budget is None:
        budget = sources.agg(F.sum("source_size")).first()[0] or 0
    shares = pinned(targets(sources, weights, most, budget), "mix-targets")

    queued = running_sums(rows, [F.col("source").asc_nulls_last(), F.col("draw"), F.col("at")], {"upto": "size"}, "mix-queues")
    known = attached(queued, shares, ["source_key"], "n")

    # Service in pass k of a queue begins where the passes before it and the documents before it end.
    begin = F.col("pass") * F.col("source_size") + F.col("upto") - F.col("before") - F.col("size")
    waiting = (
        known.where("size > 0")
        .withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))))
        .withColumn("begin", begin)
        .where("begin < quota")
        .select(
            "at",
            "doc_id",
            "source",
            "number",
            "pass",
            ((F.col("begin") + F.col("size")) / F.col("target")).alias("finish"),
            F.least(F.col("size"), F.col("quota") - F.col("begin")).alias("served"),
        )
    )
    order = [F.col(c) for c in ("finish", "number", "pass", "at")]
    merged = running_sums(waiting, order, {"place": "served"}, "mix-merged")
    within = F.least(F.col("served"), F.lit(budget) - F.col("place") + F.col("served"))
    items = merged.withColumn("taken", within).where("taken > 0")
    return Mixture(
        known.select("doc_id", "at", "size", "source", "source_size", "target"),
        items.select("at", "doc_id", "source", "pass", "taken", "finish", F.least(F.col("place"), F.lit(budget)).alias("place")),
    )


def taken_words(mixture: Mixture) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target and taken, the words that the mix takes of it in all passes."""
    taken = mixture.items.groupBy("at").agg(F.sum("taken").alias("taken"))
    return mixture.rows.join(taken, "at", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce(F.col("taken"), F.lit(0)).cast("long").alias("taken")
    )
