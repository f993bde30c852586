"""Hard-negative mining by vertical scans of decomposed vectors.

Vectors lie in segments of up to 8,192 rows, a column per dimension with its least and greatest
value. For an anchor the columns are read in the order of the anchor's magnitudes, the largest
first, a few at a time. What the columns not yet read can still add follows from their least and
greatest values; with that a bitmap of candidates shrinks until the scores left are exact.

A first scan finds each anchor's positives: a row goes where its best possible score is below the
k-th best certain one. A second scan serves all of an anchor's positives at once: a row stays
while its score may lie in some positive's window and among the first there.

Anchors are a stated share of the rows, so their blocks meet all segments. Both are dealt to the cells
of a grid, so that each is copied about as often as the square root of the number of tasks.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take
no part. Of rows with the same id the one with the smallest label, then vector, stands for all. Shorter
vectors count as filled up with zeros. Anchors without positives, and positives without negatives
in their window, have no rows. Scores of 64 bits and more are refused with an error. Empty tables
give no rows. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowkeel.session import materialise, ship_package

SEGMENT_ROWS = 8192
ANCHOR_ROWS = 256
#: Dimensions that are read between two looks at the bounds.
STRIPE = 8
SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: Bounds of a negative's score in hundredths of its positive's.
LEAST, MOST = 50, 95


def whole_numbers(rows: DataFrame, label: Column) -> DataFrame:
    """vec_id, label and the components as whole numbers of every row that takes part, one row per id."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(~odd).select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"),
        F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))).alias("q")).groupBy("vec_id").agg(
        F.min(F.struct("label", "q")).alias("one")).select("vec_id", "one.label", "one.q")


BLOCK = "vec_ids binary, labels binary, dims int, columns binary, extra array<string>"


def packer(rows: int, extra: bool):
    """Blocks of up to `rows` vectors in id order, a column per dimension; `extra` texts go along."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, rows - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == rows:
                    yield packed(pa.Table.from_batches(held), extra)
                    held, n = [], 0
        if n:
            yield packed(pa.Table.from_batches(held), extra)
    return run


def packed(t: pa.Table, extra: bool) -> pa.RecordBatch:
    t = t.sort_by("vec_id").combine_chunks()
    lists = t.column("q").combine_chunks()
    lengths = lists.value_lengths().to_numpy()
    dims = int(lengths.max())
    columns = np.zeros((t.num_rows, dims), np.int64)
    columns[np.arange(dims) < lengths[:, None]] = lists.flatten().to_numpy()
    binary = lambda a: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays([
        binary(t.column("vec_id").to_numpy()), binary(t.column("label").to_numpy().astype(np.int32)), pa.array([dims], pa.int32()),
        binary(columns.T), pa.array([t.column("extra").to_pylist() if extra else None], pa.list_(pa.string()))],
        names=[c.split()[0] for c in BLOCK.split(", ")])


def pack(vectors: DataFrame, rows: int, n: int) -> DataFrame:
    """Numbered blocks of the given vectors, of which there are n at most."""
    kept = vectors.coalesce(max(1, math.ceil(n / rows)))
    names = ["vec_id", "label", "q", *[c for c in vectors.columns if c == "extra"]]
    blocks = kept.select(*names).mapInArrow(packer(rows, "extra" in names), BLOCK)
    return materialise(blocks.withColumn("block", F.monotonically_increasing_id()), "vector-blocks")


class Columns:
    """A block's vectors by column."""

    def __init__(self, row: dict, side: str):
        self.ids = np.frombuffer(row[f"{side}vec_ids"], np.int64)
        self.labels = np.frombuffer(row[f"{side}labels"], np.int32)
        self.columns = np.frombuffer(row[f"{side}columns"], np.int64).reshape(row[f"{side}dims"], len(self.ids))
        self.extra = row[f"{side}extra"]


def scan(query: np.ndarray, columns: np.ndarray, least: np.ndarray, most: np.ndarray, bitmap: np.ndarray, keep: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Rows that `keep` leaves to the end, with their exact inner products with `query`.

    keep(partial, low, high) says which rows may stay, whose scores lie between partial + low and partial + high.
    """
    order = np.argsort(-np.abs(query), kind="stable")
    order = order[query[order] != 0]
    ends = np.stack([query * least, query * most])
    low, high = ends.min(axis=0)[order], ends.max(axis=0)[order]
    rows = np.flatnonzero(bitmap)
    partial = np.zeros(len(rows), query.dtype)
    for at in range(0, len(order), STRIPE):
        if not len(rows):
            break
        dims = order[at:at + STRIPE]
        for d in dims:
            partial += query[d] * columns[d][rows]
        stay = keep(partial, low[at + STRIPE:].sum(), high[at + STRIPE:].sum())
        if not stay.all():
            rows, partial = rows[stay], partial[stay]
    return rows, partial


def kth(values: np.ndarray, k: int):
    return np.partition(values, len(values) - k)[len(values) - k]


def first_rows(rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((rows, -scores))[:k]
    return rows[order], scores[order]


def keep_best(k: int) -> Callable:
    def keep(partial, low, high):
        return partial + high >= kth(partial, k) + low if len(partial) > k else np.ones(len(partial), bool)
    return keep


def keep_windows(windows: list[tuple[int, int]], k: int) -> Callable:
    def keep(partial, low, high):
        least, most = partial + low, partial + high
        stay = np.zeros(len(partial), bool)
        for lo, hi in windows:
            sure = least[(least >= lo) & (most <= hi)]
            floor = max(lo, kth(sure, k)) if len(sure) >= k else lo
            stay |= (most >= floor) & (least <= hi)
        return stay
    return keep


def window(score: int) -> tuple[int, int]:
    """The least and greatest score of a negative for a positive's score; empty below zero."""
    return -(-LEAST * score // 100), MOST * score // 100


def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Columns, np.ndarray, np.ndarray, np.ndarray, Columns, np.ndarray]]:
    """For each pair of a segment and a block of anchors: the segment with its columns and their bounds, the anchors with theirs."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            segment, anchors = Columns(row, "s_"), Columns(row, "a_")
            dims = min(len(segment.columns), len(anchors.columns))
            columns, queries = segment.columns[:dims], anchors.columns[:dims]
            least, most = columns.min(axis=1), columns.max(axis=1)
            reach = sum(max(abs(int(a)), abs(int(b))) * int(max(abs(int(q.min())), abs(int(q.max())))) for a, b, q in zip(least, most, queries, strict=True))
            if reach >= 2**63:
                raise OverflowError("inner products beyond 64 bits")
            # Doubles add whole numbers below 2^53 exactly, and faster.
            kind = np.float64 if reach < 2**52 else np.int64
            yield segment, columns.astype(kind), least.astype(kind), most.astype(kind), anchors, queries.astype(kind)


def positives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment, columns, least, most, anchors, queries in pairs(batches):
            of, ids, scores = [], [], []
            for i, anchor in enumerate(anchors.ids):
                rows, score = scan(np.ascontiguousarray(queries[:, i]), columns, least, most,
                                   (segment.labels == anchors.labels[i]) & (segment.ids != anchor), keep_best(k))
                rows, score = first_rows(rows, score, k)
                of += [int(anchor)] * len(rows)
                ids += segment.ids[rows].tolist()
                scores += score.astype(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (of, ids, scores)], names=["anchor_id", "positive_id", "positive_score"])
    return run


def negatives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment, columns, least, most, anchors, queries in pairs(batches):
            out: list[tuple] = []
            for i, anchor in enumerate(anchors.ids):
                asked = [tuple(map(int, p.split(":"))) for p in anchors.extra[i].split(",")]
                windows = {s: window(s) for _, s in asked}
                rows, score = scan(np.ascontiguousarray(queries[:, i]), columns, least, most, segment.labels != anchors.labels[i],
                                   keep_windows(sorted({w for w in windows.values() if w[0] <= w[1]}), k))
                for positive, s in asked:
                    lo, hi = windows[s]
                    fits = (score >= lo) & (score <= hi)
                    found, value = first_rows(rows[fits], score[fits], k)
                    out += [(int(anchor), positive, s, int(segment.ids[r]), int(v)) for r, v in zip(found, value, strict=True)]
            names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in range(5)], names=names)
    return run


def side(blocks: DataFrame, name: str) -> DataFrame:
    return blocks.select("block", *[F.col(c).alias(f"{name}_{c}") for c in ("vec_ids", "labels", "dims", "columns", "extra")])


def met(segments: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every segment beside every block of anchors, each pair in one cell of a grid."""
    tasks = 2 * int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_segments, n_anchors = max(1, segments.count()), max(1, anchors.count())
    across = min(n_segments, math.isqrt(tasks) + 1)
    down = min(n_anchors, tasks // across + 1)

    def dealt(blocks: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return blocks.withColumn(own, F.pmod(F.xxhash64("block"), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>"))).drop("block")

    s, a = dealt(side(segments, "s"), "x", across, "y", down), dealt(side(anchors, "a"), "y", down, "x", across)
    return s.join(a, ["x", "y"]).drop("x", "y")


def mine(rows: DataFrame, every: int = 50, label: Column | None = None, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows (vec_id, embedding, label) whose vec_id `every` divides; `label` may stand for the column label.
    """
    spark = rows.sparkSession
    ship_package(spark)
    n = rows.count()
    vectors = materialise(whole_numbers(rows, F.col("label") if label is None else label), "vectors")
    segments = pack(vectors, SEGMENT_ROWS, n)
    anchors = vectors.filter(F.col("vec_id") % every == 0)
    n_anchors = anchors.count()
    best = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    near = met(segments, pack(anchors, ANCHOR_ROWS, n_anchors)).mapInArrow(positives(n_positives), "anchor_id long, positive_id long, positive_score long").withColumn(
        "rank", best).filter(F.col("rank") <= n_positives)
    asked = near.groupBy("anchor_id").agg(F.array_join(F.collect_list(F.concat_ws(":", "positive_id", "positive_score")), ",").alias("extra"))
    again = anchors.join(asked, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "q", "extra")
    far = met(segments, pack(again, ANCHOR_ROWS, n_anchors)).mapInArrow(
        negatives(n_negatives), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    first = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return far.withColumn("rank", first).filter(F.col("rank") <= n_negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def moved_label() -> Column:
    """The label, which for ids divisible by seven is the next one of ten."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
    coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0)::BIGINT AS s
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
pos AS (
  SELECT a, b, s FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
neg AS (
  SELECT p.a, p.b, p.s, n.b AS c, n.s AS t, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS r
  FROM pos p JOIN pair n ON n.a = p.a AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s)
SELECT a AS anchor_id, b AS positive_id, r::INTEGER AS rank, c AS negative_id, s AS positive_score, t AS negative_score
FROM neg WHERE r <= 3"""
