"""Byte-pair encoding and decoding over a table of distinct words.

Texts are split into words in Spark, block by block. A block keeps its distinct words once, dealt to
buckets by their hashes, and every text as its words' buckets and places there. A bucket's words from all
blocks meet in one task, which encodes each distinct one once. The ids go back to the blocks by bucket
and are put together by position. Between tasks, words and ids travel as compressed arrays, one for each
block and bucket. Ids are decoded by a join with the table of ids and pieces, which has a row for each
token of the vocabulary and is therefore sent to all tasks.

A word is a run of white space and what follows it, up to the next white space. A byte-level
tokenizer never joins characters across the start of such a run, whatever stands before, so
a text's ids are those of its words. Which cuts are safe is read from the tokenizer's file:
where it normalises texts, splits them in another way or has added tokens that reach beyond their
own characters, a whole text counts as one word, with the same result.

Defined cases: a null text is an empty one and has no ids. Rows that repeat an id or a text
each get their own row. A null id stays null. An empty table gives no rows. Ids without a piece
decode to nothing. Further columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from flowkeel.llm import text as T
from flowkeel.session import bucketed, ship_package

BLOCK_BYTES = 10 << 20
#: Parts of the words, each by itself in a task; a part's distinct words are held there, up to a bound
#: beyond which the task starts again and may encode a word once more.
BUCKETS = 256
MEMO_WORDS = 2_000_000
#: Rows decoded at a time.
DECODE_ROWS = 1000
#: White space before which a text is cut, and all bytes that some tokenizers count as white space.
CUTS = np.zeros(256, bool)
CUTS[[9, 10, 13, 32]] = True
BLANKS = CUTS.copy()
BLANKS[[11, 12, 28, 29, 30, 31]] = True


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=4)
def splits_at_blanks(path: str) -> bool:
    """Whether this tokenizer encodes a text word by word."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec.get("pre_tokenizer") or {}
    own = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")) and not any(
        c.isspace() for c in t["content"]) for t in spec.get("added_tokens") or [])
    return (not spec.get("normalizer") and split.get("type") == "ByteLevel" and bool(split.get("use_regex", True))
            and not split.get("add_prefix_space") and own and not (spec.get("model") or {}).get("dropout"))


def word_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where words begin, and the end: at white space behind a character that is surely none, and where texts begin."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        blank = BLANKS[data[:-1]]
        high = np.flatnonzero((data[:-1] >= 0x80) & CUTS[data[1:]])
        if len(high):
            # Characters of two or three bytes that Unicode counts as white space end so.
            last, mid = data[high], data[np.maximum(high - 1, 0)]
            lead = data[np.maximum(high - 2, 0)]
            blank[high] = ((mid == 0xC2) & ((last == 0x85) | (last == 0xA0))) | ((lead == 0xE1) & (mid == 0x9A)) | (
                (lead == 0xE2) & ((mid == 0x80) | (mid == 0x81))) | ((lead == 0xE3) & (mid == 0x80))
        cut[1:-1] = CUTS[data[1:]] & ~blank
    cut[at] = True
    cut[-1] = True
    return np.flatnonzero(cut)


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on: their bytes, lowest first, each in a compressed row of its own."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor().compress(np.ascontiguousarray(planes).tobytes())


def expand(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros(planes.shape[1], np.int64)
    for k, plane in enumerate(planes):
        out |= plane.astype(np.int64) << (8 * k)
    return out


def splitter(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.blocks(batches, "text", BLOCK_BYTES):
            data, at = T.text_buffers(batch.column(1))
            starts = np.unique(at) if whole else word_starts(data, at)
            words = pa.LargeStringArray.from_buffers(
                len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))) if len(data) else pa.array([], pa.large_string())
            counts = np.diff(np.searchsorted(starts, at)) if len(data) else np.zeros(len(at) - 1, np.int64)
            coded = words.dictionary_encode()
            codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
            raw, cuts = T.text_buffers(distinct)
            bucket = (T.span_hashes(raw, cuts[:-1], cuts[1:]) % np.uint64(BUCKETS)).astype(np.int64)
            # Frequent words come first in their bucket, so that most places are small numbers.
            order = np.lexsort((-np.bincount(codes, minlength=len(distinct)), bucket))
            first = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order)) - first[bucket[order]]
            dealt = distinct.take(pa.array(order))
            blobs = []
            for k in range(BUCKETS):
                part, ends = T.text_buffers(dealt.slice(first[k], first[k + 1] - first[k]))
                blobs.append((squeeze(np.diff(ends)), zstandard.ZstdCompressor().compress(part.tobytes())) if len(ends) > 1 else None)
            one = lambda value: pa.array([value], pa.binary())
            yield pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0).cast(pa.int64())),
                one(squeeze(counts)), one(squeeze(bucket[codes])), one(squeeze(place[codes])),
                pa.array([[b and {"sizes": b[0], "text": b[1]} for b in blobs]], pa.list_(pa.struct({"sizes": pa.binary(), "text": pa.binary()})))],
                names=["doc_ids", "counts", "buckets", "places", "words"])
    return run


def encoder(path: str):
    """The ids of each row's words. Rows come bucket by bucket; a word that many blocks have is encoded for the first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = tokenizer(path).encode_batch_fast
        known: dict[bytes, np.ndarray] = {}
        current = None
        for batch in batches:
            answers = []
            for bucket, sizes, text in zip(*(batch.column(j).to_pylist() for j in (1, 2, 3)), strict=True):
                if bucket != current or len(known) > MEMO_WORDS:
                    known, current = {}, bucket
                ends = np.cumsum(expand(sizes)).tolist()
                text = zstandard.ZstdDecompressor().decompress(text)
                words = [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                fresh = [w for w in words if w not in known]
                known.update(zip(fresh, (np.array(e.ids, np.int64) for e in encode([w.decode() for w in fresh], add_special_tokens=False)), strict=True))
                ids = [known[w] for w in words]
                answers.append((squeeze(np.array([len(i) for i in ids])), squeeze(np.concatenate(ids))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([a[j] for a in answers], pa.binary()) for j in (0, 1))],
                                             names=["of", "bucket", "sizes", "ids"])
    return run


@lru_cache(maxsize=1)
def byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in byte-level pieces: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def pieces(path: str) -> dict[int, bytes]:
    """The bytes that each token stands for."""
    with open(path, encoding="utf-8") as f:
        if ((json.load(f).get("decoder")) or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path}: only byte-level decoders put pieces together byte by byte")
    known = byte_of_letter()
    vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
    return {i: bytes(map(known.__getitem__, p)) if all(c in known for c in p) else p.encode() for p, i in vocabulary.items()}


def as_text(raw: pa.Array) -> pa.Array:
    """Bytes as text; what is not UTF-8 becomes U+FFFD."""
    try:
        return raw.cast(pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.large_string())


def piece_array(known: dict[int, bytes]) -> pa.Array:
    """The pieces in the order of their ids, and an empty one at the end for all others."""
    return pa.array([known.get(i, b"") for i in range(max(known, default=-1) + 1)] + [b""], pa.large_binary())


def joined(lists: pa.Array, by_id: pa.Array) -> pa.Array:
    """Texts of the given lists of ids: each id meets its piece, and a list's pieces follow one another."""
    lists = lists.cast(pa.large_list(pa.int64())).fill_null([])
    texts = []
    for first in range(0, len(lists), DECODE_ROWS):
        part = lists.slice(first, DECODE_ROWS)
        ids = part.flatten().to_numpy(zero_copy_only=False)
        raw = by_id.take(pa.array(np.where((ids < 0) | (ids >= len(by_id)), len(by_id) - 1, ids)))
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(raw).to_numpy())])
        rows = np.concatenate([[0], np.cumsum(pc.list_value_length(part).to_numpy())])
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [
            None, pa.py_buffer(ends[rows].astype(np.int64)), raw.buffers()[2] or pa.py_buffer(b"")])
        texts.append(as_text(whole))
    return pa.chunked_array(texts, pa.large_string()).combine_chunks()


def joiner(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = piece_array(table.value)
        for batch in batches:
            found = joined(batch.column(batch.schema.get_field_index("ids")), by_id).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "decoded"])
    return run


def decode(rows: DataFrame, path: str) -> DataFrame:
    """`rows` (ids array<int>, any other columns) with `decoded`, the text that their ids stand for."""
    spark = rows.sparkSession
    ship_package(spark)
    table = spark.sparkContext.broadcast(pieces(path))
    kind = StructType([*rows.schema.fields, StructField("decoded", StringType())])
    return rows.mapInArrow(joiner(table), kind)


def put_together(found: pa.Table, block: pa.Table) -> pa.Table:
    """The ids of one block's texts from those of its words, by position."""
    one = {c: block.column(c)[0].as_py() for c in ("counts", "buckets", "places")}
    counts, buckets, places = (expand(one[c]) for c in one)
    answers = sorted(zip(*(found.column(c).to_pylist() for c in ("bucket", "sizes", "ids")), strict=True))
    sizes = [expand(a[1]) for a in answers]
    n_words = np.zeros(BUCKETS, np.int64)
    n_words[[a[0] for a in answers]] = [len(s) for s in sizes]
    word = (np.cumsum(n_words) - n_words)[buckets] + places
    sizes = np.concatenate([np.zeros(0, np.int64), *sizes])
    ids = np.concatenate([np.zeros(0, np.int64), *(expand(a[2]) for a in answers)]).astype(np.int32)
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), pa.array(ids)).take(pa.array(word))
    last = np.concatenate([[0], np.cumsum(counts)])
    ends = np.concatenate([[0], np.cumsum(sizes[word])])[last]
    return pa.table({"doc_id": block.column("doc_ids").combine_chunks().flatten(),
                     "ids": pa.LargeListArray.from_arrays(pa.array(ends), lists.flatten()).cast(pa.list_(pa.int32()))})


def by_blocks(docs: DataFrame, path: str, finish: Callable[[pa.Table, pa.Table], pa.Table], kind: str) -> DataFrame:
    spark = docs.sparkSession
    ship_package(spark)
    # Stored in buckets of blocks, so that the places of the words stay where they are when the ids come back.
    blocks = bucketed(docs.select("doc_id", "text").mapInArrow(
        splitter(not splits_at_blanks(path)), "doc_ids array<long>, counts binary, buckets binary, places binary, words array<struct<sizes:binary,text:binary>>").withColumn(
        "block", F.monotonically_increasing_id()), "word-blocks", int(spark.conf.get("spark.sql.shuffle.partitions")), "block")
    used = blocks.select("block", F.posexplode("words").alias("bucket", "w")).filter("w is not null").select("block", "bucket", "w.sizes", "w.text")
    known = used.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        encoder(path), "of long, bucket int, sizes binary, ids binary")
    return known.groupBy("of").cogroup(blocks.drop("words").groupBy("block")).applyInArrow(finish, kind)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>) for every row of docs (doc_id, text)."""
    return by_blocks(docs, path, put_together, "doc_id long, ids array<int>")


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>) and decoded, the text that the ids stand for, for every row of docs (doc_id, text)."""
    table = docs.sparkSession.sparkContext.broadcast(pieces(path))

    def finish(found: pa.Table, block: pa.Table) -> pa.Table:
        coded = put_together(found, block)
        return coded.append_column("decoded", joined(coded.column("ids").combine_chunks(), piece_array(table.value)).cast(pa.string()))

    return by_blocks(docs, path, finish, "doc_id long, ids array<int>, decoded string")
