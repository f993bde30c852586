"""Mixing sources to target weights by Pareto order sampling. Native expressions only.

A source's target is its share of all words; every document first gets as many certain
whole copies as fit the target. What is left is a sample of fixed size, in words: each
document has an inclusion probability that grows with the root of its size, and documents
are taken in the order of (u / (1 - u)) / (p / (1 - p)), u being a uniform number made from the id,
until the words are reached. The place where to stop comes from two rounds of sums over ranges
of the logarithm of that rank, so no source's documents are sorted in one task.

Defined cases: null, empty and white-space-only texts have size 0 and take 0. Null is a
source of its own, after all others. A repeated row is drawn on its own; equal rows
are alike, so which of them is taken makes no difference. Empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowkeel.llm.frames import same_row, sized
from flowkeel.session import materialise

WEIGHTS = (5, 2, 1)
MOST = 3
FINE = 256
FINER = 1024


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The target of every source (source, source_size, ...): one row per source, so one task sorts them.

    Sources are ordered by size per weight; those at the front are held at `most` times their
    size, and the first one below the level that the others then share fixes that level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights)) + 1)
    s = sources.withColumn("weight", weight).withColumn("limit", (most * F.col("source_size")).cast("long"))
    s = s.withColumn("ratio", F.col("limit") / F.col("weight"))
    ranked = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("limit").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(ranked.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    s = s.withColumn("k", F.row_number().over(ranked)).withColumn("level", (total - before) / after)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("k", "level"))).over(Window.partitionBy())
    return s.withColumn("level", first["level"]).withColumn(
        "target", F.least(F.col("limit").cast("double"), F.col("weight") * F.col("level"))).drop("ratio", "k", "limit", "weight", "level")


def edge(rows: DataFrame, bucket: str, base: Column) -> DataFrame:
    """The bucket of each source in which its words run out, and the words before it."""
    sums = rows.groupBy("sk", bucket).agg(F.sum("size").alias("words"), F.max("need").alias("need"), F.max(base).alias("base"))
    run = F.sum("words").over(Window.partitionBy("sk").orderBy(bucket))
    return sums.withColumn("upto", F.col("base") + run).withColumn("base", F.col("upto") - F.col("words")).filter(
        (F.col("base") < F.col("need")) & (F.col("need") < F.col("upto"))).select("sk", F.col(bucket).alias("edge"), F.col("base").alias("edge_base"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """doc_id, text_hash, size, source_size, target, copies, taken for every row of docs (doc_id, text, source)."""
    rows = materialise(docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), "source", n_words("text").alias("size"),
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("sk")).withColumn(
        "root", F.floor(F.sqrt("size"))), "sizes")
    sources = rows.groupBy("sk", "source").agg(
        F.sum("size").alias("source_size"), F.sum((F.col("size") * F.col("root")).cast("decimal(38,0)")).cast("double").alias("mass"))
    aim = sized(materialise(targets(sources, weights, most).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn(
        "need", F.col("target") - F.col("whole") * F.col("source_size")).drop("source"), "targets"))
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10)
         .cast("double") + 0.5) / 281474976710656.0
    p = F.least(F.col("root") * F.col("need") / F.col("mass"), F.lit(0.999999))
    drawn = (F.col("size") > 0) & (F.col("need") > 0)
    ranked = rows.join(aim, "sk").withColumn("q", F.when(drawn, (u / (1 - u)) / (p / (1 - p))))
    ranked = ranked.withColumn("b1", F.floor(F.log2("q") * FINE)).withColumn("b2", F.floor(F.log2("q") * (FINE * FINER)))
    live = ranked.filter("q is not null")
    first = sized(edge(live, "b1", F.lit(0).cast("long")).withColumnsRenamed({"edge": "e1", "edge_base": "base1"}))
    inside = live.join(first, "sk").filter(F.col("b1") == F.col("e1"))
    second = sized(edge(inside, "b2", F.col("base1")).withColumnsRenamed({"edge": "e2", "edge_base": "base2"}))
    last = inside.join(second, "sk").filter(F.col("b2") == F.col("e2"))
    order = Window.partitionBy("sk").orderBy("q", "doc_id", "text_hash")
    upto = F.col("base2") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(Window.partitionBy("sk", "q", "doc_id", "text_hash").orderBy("size"))
    chosen = last.withColumn("middle", upto - F.col("size") / 2).filter(F.col("middle") <= F.col("need")).select(
        "sk", "q", "doc_id", "text_hash").groupBy("sk", "q", "doc_id", "text_hash").agg(F.count("*").alias("times"))
    # Rows before the edge are taken, rows after it are not; only the few in the last range are joined.
    out = ranked.join(first, "sk", "left").join(second, "sk", "left")
    before = F.when(F.col("e1").isNull(), F.lit(True)).when(F.col("b1") != F.col("e1"), F.col("b1") < F.col("e1")).when(
        F.col("e2").isNull(), F.lit(True)).when(F.col("b2") != F.col("e2"), F.col("b2") < F.col("e2"))
    out = out.withColumn("before", F.when(F.col("q").isNull(), F.lit(False)).otherwise(before))
    keep = ["doc_id", "text_hash", "size", "source_size", "target", "whole"]
    sure = out.filter(F.col("before").isNotNull()).select(*keep, F.col("before").cast("long").alias("extra"))
    at_edge = out.filter(F.col("before").isNull())
    pick = at_edge.withColumn("place", place).join(
        chosen, (at_edge["sk"] == chosen["sk"]) & (at_edge["text_hash"] == chosen["text_hash"])
        & (at_edge["q"] == chosen["q"]) & at_edge["doc_id"].eqNullSafe(chosen["doc_id"]), "left").select(
        *[at_edge[k] for k in keep], F.coalesce(F.col("place") <= F.col("times"), F.lit(False)).cast("long").alias("extra"))
    return sure.union(pick).select(
        "doc_id", "text_hash", "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies"),
        (F.col("size") * (F.col("whole") + F.col("extra"))).alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it."""
    key = ["doc_id", "text_hash"]
    drawn = mix(docs, weights, most, seed).select(*key, "copies")
    # Rows that share an id and a text are told apart by their place only.
    rows = docs.withColumn("text_hash", F.xxhash64("text")).withColumn("_place", F.row_number().over(
        Window.partitionBy(*key).orderBy("source")))
    drawn = drawn.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy("copies")))
    both = rows.join(drawn, same_row(rows, drawn) & (rows["_place"] == drawn["_place"])).filter("copies > 0")
    return both.select(*[rows[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")


ORACLE = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS digest, hash(text) AS h
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size * floor(sqrt(size))::BIGINT)::DOUBLE AS mass FROM rows GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM src),
r AS (
  SELECT *, 3 * source_size / weight AS ratio FROM w),
k AS (
  SELECT *, row_number() OVER o AS k,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
t AS (
  SELECT source, source_size, mass,
    least(3.0::DOUBLE * source_size, weight * (SELECT arg_min(level, k) FROM k WHERE level <= ratio))::DOUBLE AS target FROM k),
need AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
u AS (
  SELECT rows.*, need.source_size, need.target, need.whole, need.target - need.whole * need.source_size AS need, need.mass,
    (('0x' || substr(digest, 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM rows JOIN need ON rows.source IS NOT DISTINCT FROM need.source),
q AS (
  SELECT *, least(floor(sqrt(size)) * need / mass, 0.999999::DOUBLE) AS p FROM u),
ranked AS (
  SELECT *, CASE WHEN size > 0 AND need > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM q),
run AS (
  SELECT *, sum(CASE WHEN q IS NULL THEN 0 ELSE size END) OVER (
    PARTITION BY source ORDER BY q NULLS LAST, doc_id, h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ranked)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN q IS NOT NULL AND upto - size / 2 <= need THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run"""
