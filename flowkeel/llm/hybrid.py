"""Ranked lexical search: term-at-a-time over short lists, then document-at-a-time with skipping.

Documents are indexed in segments of about 16 MB of text. A segment holds its terms' hashes in order,
their lists of local document numbers and counts, and for every 128 entries of a list the largest
count and the shortest document, from which the most that the block can add to a score follows.
No list reaches beyond its segment, so a frequent term is spread over all of them.

Items are searched in blocks of bounded size. A first pass over the segments' term counts gives the
block's document frequencies, a second ranks. In a segment an item's short lists are summed term at
a time into accumulators. Those stand for one list from then on, with a bound of its own. It and the
long lists are walked together through ranges of document numbers: a range is skipped where the bounds
of what the lists hold there stay below the score to beat, lists whose bounds add up to less than
that only complete candidates of the other lists, and candidates leave as soon as they cannot reach it.
Scores are integers and only what is surely lower is skipped, so the result is exact.

Terms are compared by 64-bit hashes, which two different terms share with probability 2^-64.

Defined cases: null texts have no terms. Every row of documents and of items counts for itself, rows
that repeat others too; of equal scores the smaller doc_id comes first, null ids last. Items without
known terms have no rows; a null item id stays null. Empty tables give no rows. Further columns are
not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowkeel.llm import text as T
from flowkeel.llm.compact import load, save
from flowkeel.session import fresh_path, materialise, ship_package

SEGMENT_BYTES = 16 << 20
#: Entries that share a bound.
BLOCK = 128
#: Document numbers that are walked through at a time.
RANGE = 2048
#: Short lists, together, have one entry per so many documents of the segment.
SHORT = 8
#: Items and terms of a block of items.
BLOCK_ITEMS = 4096
BLOCK_TERMS = 1 << 20
MOST_TASKS = 100_000

#: ASCII characters that part terms: all but digits and letters.
PARTS = np.ones(256, bool)
PARTS[48:58] = PARTS[65:91] = PARTS[97:123] = PARTS[128:] = False


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the texts, and where each text's begin."""
    data, at = T.text_buffers(column)
    start, end, first = T.word_spans(data, at, PARTS)
    return T.span_hashes(data, start, end), first


def runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    return np.flatnonzero(fresh)


SEGMENT = "n_docs long, n_terms long, doc_ids array<long>, sizes binary, terms binary, dfs binary, docs binary, tfs binary, most binary, least binary"


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An index of each block of documents; documents are numbered by ascending id, nulls last."""
    for batch in T.blocks(batches, "text", SEGMENT_BYTES):
        batch = batch.take(pc.sort_indices(batch, sort_keys=[("doc_id", "ascending")], null_placement="at_end"))
        words, first = terms(batch.column(1))
        sizes = np.diff(first)
        owner = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
        order = np.lexsort((owner, words))
        words, owner = words[order], owner[order]
        fresh = np.ones(len(words), bool)
        fresh[1:] = (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(fresh)
        tfs = np.diff(np.append(at, len(words))).astype(np.int32)
        words, docs = words[at], owner[at].astype(np.int32)
        lists = runs(words)
        dfs = np.diff(np.append(lists, len(words))).astype(np.int32)
        cuts = block_starts(dfs)
        most = np.maximum.reduceat(tfs, cuts) if len(cuts) else tfs
        least = np.minimum.reduceat(sizes[docs], cuts) if len(cuts) else sizes[:0]
        raw = [sizes.astype(np.int64), words[lists], dfs, docs, tfs, most, least.astype(np.int64)]
        yield pa.RecordBatch.from_arrays([
            pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())]),
            pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0).cast(pa.int64())),
            *[pa.array([a.tobytes()], pa.binary()) for a in raw]], names=[c.split()[0] for c in SEGMENT.split(", ")])


def block_starts(dfs: np.ndarray) -> np.ndarray:
    """Where blocks of `BLOCK` entries begin; a list begins a block."""
    n = -(-dfs.astype(np.int64) // BLOCK)
    first = np.cumsum(n) - n
    lists = np.cumsum(dfs, dtype=np.int64) - dfs
    return np.repeat(lists, n) + BLOCK * (np.arange(int(n.sum())) - np.repeat(first, n))


#: A segment's arrays: what its file of terms and its file of lists hold, behind the documents' ids and which of them are known.
TERMS = {"terms": np.uint64, "dfs": np.int32}
LISTS = {"sizes": np.int64, "docs": np.int32, "tfs": np.int32, "most": np.int32, "least": np.int64}
INDEX = "path string, n_docs long, n_terms long"


def stored(folder: str):
    """Writes segments to files that tasks map: as values of rows they would pass through the JVM's memory, several at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in segments(batches):
            path, ids = f"{folder}/{uuid.uuid4().hex}", found.column("doc_ids").values
            held = {name: np.frombuffer(found.column(name)[0].as_buffer(), kind) for name, kind in (TERMS | LISTS).items()}
            save(path + ".terms", [held[name] for name in TERMS])
            save(path + ".lists", [ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), *[held[name] for name in LISTS]])
            yield pa.RecordBatch.from_arrays([pa.array([path]), found.column("n_docs"), found.column("n_terms")], names=["path", "n_docs", "n_terms"])
    return run


def opened(path: str, lists: bool = True) -> dict:
    """The arrays of a stored segment."""
    array = load(path + ".terms")
    row = {name: array(kind) for name, kind in TERMS.items()}
    if lists:
        array = load(path + ".lists")
        row |= {"ids": array(np.int64), "known": array(bool), **{name: array(kind) for name, kind in LISTS.items()}}
    return row


def build(docs: DataFrame) -> DataFrame:
    """The index of all rows of docs (doc_id, text), stored in the shared folder; a row per segment names its files."""
    ship_package(docs.sparkSession)
    folder = fresh_path(docs.sparkSession, "segments")
    return materialise(docs.select("doc_id", "text").mapInArrow(stored(folder), INDEX), "segment-names")


def term_weights(dfs: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * dfs + 1))).astype(np.int64)


def doc_factor(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    # Products of sizes and counts may pass 64 bits; Python's integers do not.
    if not len(sizes) or not n_terms or 90 * int(sizes.max()) * n_docs < 2**63:
        return 10 + 90 * sizes * n_docs // max(n_terms, 1)
    return np.array([10 + 90 * int(s) * n_docs // n_terms for s in sizes], np.int64)


def gain(tfs: np.ndarray, factor: np.ndarray) -> np.ndarray:
    tfs = tfs.astype(np.int64)
    return 1_000_000_000 * tfs // (1000 * tfs + 8 * factor)


class Segment:
    """One segment's lists, with scores under the corpus-wide counts."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        array = lambda name, kind: np.frombuffer(row[name], kind)
        self.terms, self.dfs, self.docs, self.tfs = array("terms", np.uint64), array("dfs", np.int32), array("docs", np.int32), array("tfs", np.int32)
        self.factor = doc_factor(array("sizes", np.int64), n_docs, n_terms)
        self.first = np.concatenate([[0], np.cumsum(self.dfs, dtype=np.int64)])
        blocks = -(-self.dfs.astype(np.int64) // BLOCK)
        self.first_block = np.concatenate([[0], np.cumsum(blocks)])
        self.top = gain(array("most", np.int32), doc_factor(array("least", np.int64), n_docs, n_terms))
        self.size = len(self.factor)

    def part(self, k: int, lo: int, hi: int, weight: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries lo to hi of list k: documents and what the term adds to their scores."""
        at = slice(self.first[k] + lo, self.first[k] + hi)
        docs = self.docs[at]
        return docs, weight * gain(self.tfs[at], self.factor[docs])

    def list_docs(self, k: int) -> np.ndarray:
        return self.docs[self.first[k]:self.first[k + 1]]


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """All documents of the given entries in order, with their summed scores."""
    docs, scores = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(docs, kind="stable")
    docs, scores = docs[order], scores[order]
    at = runs(docs)
    return docs[at], np.add.reduceat(scores, at) if len(at) else scores


def best(docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, equal ones by document number."""
    if len(docs) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= floor
        docs, scores = docs[keep], scores[keep]
    order = np.lexsort((docs, -scores))[:k]
    return docs[order], scores[order]


def search_segment(segment: Segment, at: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of the segment's k best documents for the lists `at` with their terms' weights."""
    by_length = np.argsort(segment.dfs[at], kind="stable")
    lists = [(int(at[i]), int(weights[i])) for i in by_length if weights[i] > 0]
    upto = np.cumsum([segment.dfs[i] for i, _ in lists]) if lists else np.zeros(0, np.int64)
    n_short = int(np.searchsorted(upto, max(segment.size // SHORT, 4 * k), "right"))
    none = (np.zeros(0, np.int32), np.zeros(0, np.int64))
    # Term at a time: the short lists become accumulators.
    sum_docs, sum_scores = summed([none, *[segment.part(i, 0, int(segment.dfs[i]), w) for i, w in lists[:n_short]]])
    long_ = lists[n_short:]
    found = best(sum_docs, sum_scores, k)
    if not long_:
        return found
    # What a document has from the short lists alone is the least it will have.
    beat = int(found[1][-1]) if len(found[1]) == k else 1
    walked = none
    places = [segment.list_docs(i) for i, _ in long_]
    edges = np.arange(0, segment.size + RANGE, RANGE)
    marks = [np.searchsorted(p, edges).tolist() for p in (*places, sum_docs)]
    sums = len(long_)  # the accumulators are one more list

    for r in range(len(edges) - 1):
        cut = [(m[r], m[r + 1]) for m in marks]
        bounds = [0] * (sums + 1)
        for j, (i, w) in enumerate(long_):
            lo, hi = cut[j]
            if hi > lo:
                bounds[j] = w * int(segment.top[segment.first_block[i] + lo // BLOCK:segment.first_block[i] + (hi - 1) // BLOCK + 1].max())
        s = slice(*cut[sums])
        bounds[sums] = int(sum_scores[s].max()) if s.stop > s.start else 0
        if sum(bounds) < beat:
            continue
        # Lists whose bounds, in ascending order, stay below `beat` together cannot bring up a candidate.
        order = sorted(range(sums + 1), key=bounds.__getitem__)
        passive, rest = [], 0
        while rest + bounds[order[len(passive)]] < beat:
            rest += bounds[order[len(passive)]]
            passive.append(order[len(passive)])
        parts = [(sum_docs[s], sum_scores[s]) if j == sums else segment.part(long_[j][0], *cut[j], long_[j][1]) for j in order[len(passive):]]
        docs, scores = summed(parts)
        for j in reversed(passive):
            keep = scores + rest >= beat
            docs, scores = docs[keep], scores[keep]
            rest -= bounds[j]
            own = sum_docs[s] if j == sums else places[j][slice(*cut[j])]
            if not len(own) or not len(docs):
                continue
            spot = np.minimum(np.searchsorted(own, docs), len(own) - 1)
            hit = np.flatnonzero(own[spot] == docs)
            if j == sums:
                scores[hit] += sum_scores[s][spot[hit]]
            else:
                i, w = long_[j]
                scores[hit] += w * gain(segment.tfs[segment.first[i] + cut[j][0] + spot[hit]], segment.factor[docs[hit]])
        keep = scores >= beat
        walked = best(np.concatenate([walked[0], docs[keep]]), np.concatenate([walked[1], scores[keep]]), k)
        if len(walked[1]) == k:
            beat = max(beat, int(walked[1][-1]))
    return walked


def counter(wanted):
    """Of a block's terms: their place in it and in how many documents of each segment they occur."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = wanted.value
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                own, dfs = opened(path, lists=False).values()
                if len(own):
                    spot = np.minimum(np.searchsorted(own, asked), len(own) - 1)
                    total += np.where(own[spot] == asked, dfs[spot], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["place", "df"])
    return run


def ranker(wanted, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights, items, n_docs, n_terms = wanted.value
        for batch in batches:
            for path in batch.column(0).to_pylist():
                row = opened(path)
                segment = Segment(row, n_docs, n_terms)
                if not len(segment.terms):
                    continue
                spot = np.minimum(np.searchsorted(segment.terms, asked), len(segment.terms) - 1)
                spot = np.where(segment.terms[spot] == asked, spot, -1)
                names, docs, scores = [], [], []
                for number, places in items:
                    own = places[spot[places] >= 0]
                    if not len(own):
                        continue
                    d, s = search_segment(segment, spot[own], weights[own], k)
                    names += [number] * len(d)
                    docs += [int(row["ids"][i]) if row["known"][i] else None for i in d]
                    scores += s.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(docs, pa.int64()), pa.array(scores, pa.int64())],
                                                 names=["item", "doc_id", "score"])
    return run


def item_blocks(rows: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Numbered items with the hashes of their terms, in blocks of bounded size; a block at a time is in the driver."""
    block, size = [], 0
    for row in rows.toLocalIterator():
        own = np.frombuffer(row["terms"], np.uint64)
        if block and (len(block) == BLOCK_ITEMS or size + len(own) > BLOCK_TERMS):
            yield block
            block, size = [], 0
        block.append((row["item"], own))
        size += len(own)
    if block:
        yield block


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in T.blocks(batches, "text"):
        words, first = terms(batch.column(1))
        sets = [np.unique(words[first[i]:first[i + 1]]).tobytes() for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["item", "terms"])


def search(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of the index for every row of items (item_id, text)."""
    spark = index.sparkSession
    ship_package(spark)
    n_docs, n_terms, n = (int(v or 0) for v in index.agg(F.sum("n_docs"), F.sum("n_terms"), F.count("*")).first())
    # The rows are small and the files that they name are not: a task for each.
    paths = index.select("path").repartition(max(1, min(n, MOST_TASKS)))
    numbered = materialise(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")
    asked = materialise(numbered.select("item", "text").mapInArrow(item_terms, "item long, terms binary"), "item-terms")
    out = None
    for block in item_blocks(asked):
        words = np.unique(np.concatenate([t for _, t in block]))
        if not len(words):
            continue
        sent = spark.sparkContext.broadcast(words)
        dfs = np.zeros(len(words), np.int64)
        for place, df in paths.mapInArrow(counter(sent), "place long, df long").groupBy("place").agg(F.sum("df")).collect():
            dfs[place] = df
        places = [(n, np.searchsorted(words, t)) for n, t in block]
        full = spark.sparkContext.broadcast((words, term_weights(dfs, n_docs), places, n_docs, n_terms))
        found = paths.mapInArrow(ranker(full, k), "item long, doc_id long, score long")
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], "item long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    top = out.withColumn("rank", rank).filter(F.col("rank") <= k)
    return top.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL),
size AS (SELECT r, doc_id, len(t)::BIGINT AS n, t FROM d WHERE len(t) > 0),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM size),
post AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(t) AS t FROM size) GROUP BY ALL),
weight AS (
  SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM post, total GROUP BY t),
item AS (
  SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t
  FROM benchmark WHERE text IS NOT NULL),
scored AS (
  SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM (SELECT q, item_id, unnest(t) AS t FROM item) JOIN post USING (t) JOIN weight USING (t), total
  GROUP BY q, item_id, r, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10"""
