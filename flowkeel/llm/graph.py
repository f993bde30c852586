"""Connected components of a link table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowkeel.session import materialise


def components(links: DataFrame) -> DataFrame:
    """Smallest member (`root`) of the component of every `node` in links (a, b).

    Each round a node takes the smallest root among its neighbours, by an aggregation
    with map-side combine, and then its root's root; no node's links meet in one
    task, and paths shorten by half and more. Rounds are written to the shared folder.
    """
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    roots = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("root"))
    roots = materialise(roots, "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(
            F.min("root").alias("m"))
        lower = roots.join(near, roots["node"] == near["a"]).select(
            "node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        up = lower.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        lower = lower.join(up, "root", "left").select("node", "old", F.coalesce("higher", "root").alias("root"))
        stored = materialise(lower, "roots")
        roots = stored.select("node", "root")
        if not stored.filter(F.col("old") != F.col("root")).limit(1).count():
            return roots
