"""Token ids in files of fixed-width bits, read back at random.

A file holds the documents of one range of ids: the packed blocks, then their offsets, the
documents' ids with null marks and their first tokens, and at its end the mark, bits per id,
ids per block, documents, ids and blocks. An id takes the fewest bits that hold the vocabulary. A
block starts at a byte, so any document is unpacked from its own blocks alone, all ids at once.

Words are encoded once per worker: the tokenizer never joins text across ASCII white
space, so a text's ids are those of its words. A bounded memo keeps the ids of known words.

Defined cases: a null or empty text has only the end id. Rows that repeat an id follow one
another. An empty table gives no file and no rows. Further columns are not read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowkeel.llm import text as T
from flowkeel.llm.frames import keyed
from flowkeel.llm.ordered import in_ranges
from flowkeel.llm.store import map_file, open_fs
from flowkeel.session import fresh_path, materialise, ship_package

MARK = b"IDS1"
FOOTER = struct.Struct("<4sIIQQQ")
BLOCK = 4096
MEMO_WORDS = 1_500_000
END_ID = 1


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as little-endian bit fields; the last byte is filled with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    fields = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(fields.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data, n: int, bits: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if bits in (8, 16, 32):
        return raw[:n * bits // 8].view(f"<u{bits // 8}").astype(np.uint32)
    at = np.arange(n, dtype=np.int64) * bits
    wide = np.concatenate([raw, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        word |= wide[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Writer:
    """Streams one file; memory holds a block and the documents' places."""

    def __init__(self, uri: str, bits: int):
        self.bits, self.buffer, self.left = bits, [], 0
        self.offsets, self.docs, self.nulls, self.starts, self.n = [0], [], [], [], 0
        self.system, self.path = open_fs(uri)
        self.system.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.system.open_output_stream(self.own)

    def add(self, docs: list[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        self.docs.append(np.array([d or 0 for d in docs], np.int64))
        self.nulls.append(np.array([d is None for d in docs], np.uint8))
        self.starts.append(self.n + np.cumsum(counts) - counts)
        self.n += int(counts.sum())
        self.buffer.append(ids)
        self.left += len(ids)
        if self.left >= 64 * BLOCK:
            self.flush(self.left // BLOCK * BLOCK)

    def flush(self, upto: int) -> None:
        ids = np.concatenate(self.buffer) if self.buffer else np.zeros(0, np.uint32)
        for i in range(0, upto, BLOCK):
            block = pack(ids[i:min(i + BLOCK, upto)], self.bits)
            self.out.write(block)
            self.offsets.append(self.offsets[-1] + len(block))
        self.buffer, self.left = [ids[upto:]], len(ids) - upto

    def close(self) -> tuple[int, int]:
        self.flush(self.left)
        docs = np.concatenate(self.docs)
        for part in (np.array(self.offsets, np.uint64), docs, np.concatenate(self.nulls),
                     np.append(np.concatenate(self.starts), self.n).astype(np.uint64)):
            self.out.write(part.tobytes())
        self.out.write(FOOTER.pack(MARK, self.bits, BLOCK, len(docs), self.n, len(self.offsets) - 1))
        self.out.close()
        self.system.move(self.own, self.path)
        return len(docs), self.n


class Reader:
    """Random access to one file; only the blocks asked for are touched."""

    def __init__(self, uri: str):
        self.data = map_file(uri)
        tail = len(self.data) - FOOTER.size
        mark, self.bits, self.block, self.n_docs, self.n, blocks = FOOTER.unpack(self.data[tail:])
        if mark != MARK:
            raise ValueError(f"not a file of packed ids: {uri}")
        at = tail - 8 * (self.n_docs + 1)
        self.starts = np.frombuffer(self.data[at:tail], np.uint64).astype(np.int64)
        self.nulls = np.frombuffer(self.data[at - self.n_docs:at], np.uint8)
        at -= self.n_docs
        self.docs = np.frombuffer(self.data[at - 8 * self.n_docs:at], np.int64)
        at -= 8 * self.n_docs
        self.offsets = np.frombuffer(self.data[at - 8 * (blocks + 1):at], np.uint64).astype(np.int64)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids at positions first to last - 1 of the file."""
        if last <= first:
            return np.zeros(0, np.uint32)
        lo, hi = first // self.block, (last - 1) // self.block
        parts = [unpack(self.data[self.offsets[b]:self.offsets[b + 1]], min(self.block, self.n - b * self.block), self.bits)
                 for b in range(lo, hi + 1)]
        return np.concatenate(parts)[first - lo * self.block:last - lo * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


class WordIds:
    """The tokenizer with a memo of words, by their hash."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bits = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self.keys, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        if len(self.keys) + len(keys) > MEMO_WORDS:
            self.clear()
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        count = np.array([len(i) for i in ids], np.int32)
        first = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate([self.flat, np.fromiter((x for i in ids for x in i), np.uint32, int(count.sum()))])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first = np.insert(self.keys, at, keys), np.insert(self.first, at, first)
        self.count = np.insert(self.count, at, count)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by the end id, and the number of ids of each."""
        start, end, first = T.word_spans(data, at)
        keys = T.span_hashes(data, start, end, T._values)
        fresh, where, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(fresh) > MEMO_WORDS:
            self.clear()
        at_key = np.minimum(np.searchsorted(self.keys, fresh), max(0, len(self.keys) - 1))
        new = self.keys[at_key] != fresh if len(self.keys) else np.ones(len(fresh), bool)
        if new.any():
            spans = where[new]
            raw = data.tobytes()
            self.learn(fresh[new], [raw[s:e].decode() for s, e in zip(start[spans].tolist(), end[spans].tolist(), strict=True)])
        place = np.searchsorted(self.keys, fresh)
        at_word, n_word = self.first[place][back], self.count[place][back].astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(n_word)])
        per_text = sums[first[1:]] - sums[first[:-1]] + 1
        ends = np.cumsum(per_text)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        keep = np.ones(len(out), bool)
        keep[ends - 1] = False
        out[~keep] = END_ID
        step = np.arange(sums[-1]) - np.repeat(sums[:-1], n_word)
        out[keep] = self.flat[np.repeat(at_word, n_word) + step]
        return out, per_text


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def file_writer(path: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, open_bucket, writer = word_ids(path), None, None

        def done():
            uri = f"{folder}/part-{open_bucket:08d}.ids"
            docs, ids = writer.close()
            return pa.RecordBatch.from_pydict({"bucket": [open_bucket], "path": [uri], "docs": [docs], "ids": [ids]},
                                              schema=pa.schema([("bucket", pa.int32()), ("path", pa.string()),
                                                                ("docs", pa.int64()), ("ids", pa.int64())]))

        for batch in T.blocks(batches, "text", T.BLOCK_BYTES):
            buckets = np.asarray(batch.column(0))
            cuts = np.flatnonzero(np.diff(buckets)) + 1
            ids, counts = coder.encode(*T.text_buffers(batch.column(2)))
            docs, ends = batch.column(1).to_pylist(), np.concatenate([[0], np.cumsum(counts)])
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(buckets)], strict=True):
                if buckets[lo] != open_bucket:
                    if writer:
                        yield done()
                    open_bucket = int(buckets[lo])
                    writer = Writer(f"{folder}/part-{open_bucket:08d}.ids", coder.bits)
                writer.add(docs[lo:hi], ids[ends[lo]:ends[hi]], counts[lo:hi])
        if writer:
            yield done()
    return run


def write_ids(docs: DataFrame, tokenizer_path: str, folder: str, parts: int | None = None) -> DataFrame:
    """Writes docs (doc_id, text) in ascending id order; returns bucket, path, docs, ids, first per file.

    `first` is the number of ids in all files before: a window over one row per file.
    """
    ship_package(docs.sparkSession)
    ranged, n = in_ranges(keyed(docs), parts)
    rows = ranged.select("bucket", "doc_id", "text", "text_hash").repartitionById(n, F.col("bucket"))
    written = rows.sortWithinPartitions("bucket", "doc_id", "text_hash").select("bucket", "doc_id", "text").mapInArrow(
        file_writer(tokenizer_path, folder), "bucket int, path string, docs long, ids long")
    files = materialise(written, "files")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("first", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long"))


def read_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            file = Reader(path)
            for lo in range(0, file.n_docs, 1024):
                hi = min(lo + 1024, file.n_docs)
                starts = file.starts[lo:hi + 1]
                crc = []
                if starts[-1] - starts[0] <= 1 << 22:
                    ids = file.ids(int(starts[0]), int(starts[-1])).astype("<u4")
                    at = starts - starts[0]
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                else:
                    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                        sum_ = 0
                        for i in range(a, b, 1 << 20):
                            sum_ = zlib.crc32(file.ids(i, min(b, i + (1 << 20))).astype("<u4"), sum_)
                        crc.append(sum_)
                yield pa.RecordBatch.from_arrays([
                    pa.array(file.docs[lo:hi], pa.int64(), mask=file.nulls[lo:hi].astype(bool)),
                    pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the written files."""
    rows = materialise(files.select("path", "first", "bucket"), "placed")
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, "bucket").select("path", "first").mapInArrow(
        read_file, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer_path: str, folder: str | None = None, parts: int | None = None) -> DataFrame:
    """Writes all documents to `folder` (by default a new one in the shared folder) and reads the files back."""
    folder = folder or fresh_path(docs.sparkSession, "ids")
    return read_ids(write_ids(docs, tokenizer_path, folder, parts))
