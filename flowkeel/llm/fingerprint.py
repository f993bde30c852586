"""MinHash fingerprints and the near-duplicate groups that their bands find.

128 multiply-shift hashes of a text's 5-word shingles, in numpy; a fingerprint is the minima in
hexadecimal, and the likeness of two is their share of equal minima, an estimate of the
sets' Jaccard similarity.

Defined cases: a null text is an empty one. Texts without words share the fingerprint of
the empty set, are fully alike to each other and not at all to any other text. Among rows
that repeat an id the text's hash decides the order; null ids come last in descending order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowkeel.llm import circulant
from flowkeel.llm import text as T
from flowkeel.llm.frames import keyed, same_row
from flowkeel.llm.ordered import in_ranges
from flowkeel.session import ship_package

PERMUTATIONS = 128
NONE = np.uint32(0xFFFFFFFF)


def minima(sets: np.ndarray, first: np.ndarray, width: int = PERMUTATIONS) -> np.ndarray:
    rng = np.random.default_rng(271828)
    a = rng.integers(1, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**64 - 1, width, dtype=np.uint64)
    out = np.full((len(first) - 1, width), NONE, np.uint32)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for lo in range(0, len(sets), 2048):
        own = owner[lo:lo + 2048]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        values = sets[lo:lo + 2048, None] * a
        values += b
        low = (np.minimum.reduceat(values, starts, axis=0) >> np.uint64(32)).astype(np.uint32)
        rows = own[starts]
        out[rows] = np.minimum(out[rows], low)
    return out


def fingerprints(column: pa.Array) -> np.ndarray:
    return minima(*T.shingle_sets(*T.word_hashes(*T.text_buffers(column))))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def hexed(prints: np.ndarray) -> list[str]:
    raw = np.ascontiguousarray(prints.astype(">u4")).tobytes().hex()
    step = 8 * prints.shape[1]
    return [raw[i * step:(i + 1) * step] for i in range(len(prints))]


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many from the start of the next text."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


OUTPUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket in descending order; each bucket ends with the next one's first row as `halo`."""
    held = None
    for batch in T.blocks(batches, "text"):
        bucket, halo = np.asarray(batch.column(0)), np.asarray(batch.column(1).cast(pa.int8()))
        texts, prints = batch.column(3).fill_null("").to_pylist(), fingerprints(batch.column(3))
        ids = batch.column(2).to_pylist()
        if held:
            bucket, halo = np.append(held[0], bucket), np.append(held[1], halo)
            ids, texts, prints = [held[2], *ids], [held[3], *texts], np.vstack([held[4][None], prints])
        held = (bucket[-1], halo[-1], ids[-1], texts[-1], prints[-1])
        # A row is answered by the row behind it; a bucket's last row is a halo row, which asks nothing.
        ask = np.flatnonzero((halo[:-1] == 0) & (bucket[:-1] == bucket[1:]))
        if not len(ask):
            continue
        changed = [edited(texts[i], texts[i + 1]) for i in ask]
        after = fingerprints(pa.array(changed, pa.large_string()))
        mine = prints[ask]
        yield pa.RecordBatch.from_arrays([
            pa.array([ids[i] for i in ask], pa.int64()), pa.array([len(texts[i]) for i in ask], pa.int64()),
            pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed]), pa.array(hexed(mine)), pa.array(hexed(after)),
            pa.array(likeness(mine, after)), pa.array(likeness(mine, prints[ask + 1]))], names=[c.split()[0] for c in OUTPUT.split(", ")])


def edited_likeness(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every row of docs (doc_id, text), of its edited text, and their likeness.

    Ids are cut into ranges; the head of each range, one row, is copied to the range
    before it, so that every row meets its follower without a sort of all rows in one task.
    """
    spark = docs.sparkSession
    ship_package(spark)
    ranged, n = in_ranges(keyed(docs), parts)
    head = ranged.select("bucket", "doc_id", "text_hash").groupBy("bucket").agg(
        F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text_hash")).alias("head"))
    tops = sorted((r["bucket"], r["head"]["doc_id"], r["head"]["text_hash"]) for r in head.collect())  # one small row per range
    if not tops:
        return spark.createDataFrame([], OUTPUT)
    goes = [(tops[i][1], tops[i][2], tops[(i + 1) % len(tops)][0]) for i in range(len(tops))]
    to = F.broadcast(spark.createDataFrame(goes, "doc_id long, text_hash long, to int"))  # one row per range
    halo = ranged.join(to, same_row(ranged, to)).select(
        F.col("to").alias("bucket"), F.lit(True).alias("halo"), ranged["doc_id"], ranged["text_hash"], "text")
    rows = ranged.select("bucket", F.lit(False).alias("halo"), "doc_id", "text_hash", "text").union(halo)
    return (rows.repartitionById(n, F.col("bucket"))
            .sortWithinPartitions("bucket", "halo", F.col("doc_id").desc_nulls_last(), F.col("text_hash").desc())
            .select("bucket", "halo", "doc_id", "text").mapInArrow(compare, OUTPUT))


def near_groups(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Near-duplicate groups: bands of these fingerprints are joined and candidates confirmed on full sets."""
    return circulant.near_groups(docs, percent, signer=minima)
