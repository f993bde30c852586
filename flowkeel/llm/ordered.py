"""Documents in id order over many tasks: consecutive ranges of ids with about equal row counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounds(docs: DataFrame, parts: int) -> list[int]:
    """At most parts - 1 ascending ids that cut the documents into ranges."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [1.0], max(10_000, 20 * parts))).first()[0]
    return sorted(set(cuts or [])) if parts > 1 else []


def bucket_of(cuts: list[int]) -> Column:
    """How many cuts lie below or at doc_id, by binary search; a null id comes first."""
    if not cuts:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    known = F.array(*[F.lit(c).cast("long") for c in cuts])
    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, step: F.when(F.coalesce(F.get(known, at + step - 1) <= F.col("doc_id"), F.lit(False)), at + step).otherwise(at)))


def in_ranges(docs: DataFrame, parts: int | None = None) -> tuple[DataFrame, int]:
    """`docs` with a column `bucket` that rises with doc_id, and the number of buckets."""
    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = bounds(docs, n)
    return docs.withColumn("bucket", bucket_of(cuts)), len(cuts) + 1
