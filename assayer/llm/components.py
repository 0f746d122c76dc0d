"""Connected components of links between integer ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import pinned


def components(links: DataFrame) -> DataFrame:
    """doc_id, label (the smallest id reachable) of every id in ``links`` (a, b).

    Each round passes labels on to neighbours and then replaces a label by the
    label of the id it names, so chains shrink to about half. Rounds are written
    to the shared folder; the driver only sees whether a label has changed.
    """
    edges = pinned(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        "components-edges",
    )
    labels = pinned(edges.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "components-0")
    while True:
        named = labels.select(F.col("doc_id").alias("b"), F.col("label").alias("theirs"))
        heard = edges.join(named, "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("theirs").alias("heard"))
        lower = labels.join(heard, "doc_id").select("doc_id", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("doc_id").alias("label"), F.col("label").alias("further"))
        new = pinned(
            lower.join(jump, "label", "left").select("doc_id", "old", F.least("label", "further").alias("label")), "components-round"
        )
        labels = new.select("doc_id", "label")
        if new.where("old <> label").isEmpty():
            return labels
