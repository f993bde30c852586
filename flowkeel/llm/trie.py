"""Elias-Fano n-gram language model: compact sorted levels, memory-mapped from the shared folder.

Words are numbered in the order of their 64-bit hashes and cut into shards by hash range; an
n-gram lives in the shard of its first word. From level 2 a shard is cut into parts, ranges of contexts
that follow at most about `part_tokens` tokens unless they are one context; a frequent first word so
spreads over many parts. Level n holds, for every (n-1)-gram of level
n - 1 in turn, the last words of its n-grams. A last word is written as its rank among
the successors of the context without its first word, which is smaller than its number; adding
the context's base makes one ascending sequence. That sequence and the pointers (bases, and
first children) are Elias-Fano coded, and an n-gram is found by a successor search: the
high part names a bucket by a select on zeros, the low parts in it are compared. Each n-gram has
one byte for its probability and each context one for its backoff, on a logarithmic grid.

Probabilities are interpolated absolute discounting down to (c + 0.5) / (N + 0.5 (V + 1)) for single
words. Building level n is one pass over the training texts: each task looks its
n-grams' contexts up in the levels below, sorts and counts them, and sends each part
one packed block; one task per part merges those, folding equal n-grams as blocks come, so that it holds no
more than its distinct n-grams twice. Those of one context are at most as many as the words. Nothing
is gathered in the driver but one row of counts per part.

The shared folder must be reachable as files (a mounted path, or any store pyarrow opens).

Defined cases: a null or empty text is its end token alone. Words never seen in training count 0.
Rows that repeat an id fall on the same side of the split, as does a null id, whose text
form is empty. Empty training data give every token the probability 0.5 / (0.5 (V + 1)).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowkeel.llm import text as T
from flowkeel.llm.compact import ONE, Sequence, by_shard, load, save, squeeze
from flowkeel.llm.store import delete_file, exists, map_file, write_file
from flowkeel.session import fresh_path, materialise, ship_package

ORDER = 3
SHARD_BYTES = 16 << 20
FLUSH = 3_000_000
#: Tokens after the contexts of one part, and entries at which blocks are folded.
PART_TOKENS = 4_000_000
FOLD = 2_000_000
BEGIN, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543211)


@dataclass(frozen=True)
class Parts:
    """The parts of a level: shard and first context of each, how many contexts, and its first n-gram in the shard."""

    shard: tuple[int, ...]
    context: tuple[int, ...]
    contexts: tuple[int, ...]
    gram: tuple[int, ...] = ()

    @staticmethod
    def of(shards: list[int], firsts: list[int], sizes: list[int], cuts: list[list[int]]) -> Parts:
        """Parts of the contexts that lie in runs (shard, first, size), each cut at the places given."""
        rows = [(s, f + a, b - a) for s, f, n, c in zip(shards, firsts, sizes, cuts, strict=True)
                for a, b in zip([0, *c], [*c, n], strict=True)]
        return Parts(*(tuple(r[i] for r in rows) for i in range(3)))

    def find(self, shard: np.ndarray, context: np.ndarray) -> np.ndarray:
        starts = (np.array(self.shard, np.int64) << 40) | np.array(self.context, np.int64)
        return np.searchsorted(starts, (shard << 40) | context, side="right") - 1

    def counted(self, grams: list[int]) -> Parts:
        """With the places of their first n-grams, given how many each has."""
        before, at, shard = [], 0, -1
        for s, n in zip(self.shard, grams, strict=True):
            at = at if s == shard else 0
            before.append(at)
            shard, at = s, at + n
        return replace(self, gram=tuple(before))


@dataclass(frozen=True)
class Plan:
    """Where the levels are and the counts that all tasks need."""

    folder: str
    shards: int
    order: int = ORDER
    tokens: int = 0
    words: int = 0
    #: Word numbers before each shard.
    first_word: tuple[int, ...] = ()
    #: Per finished level from 2: the most children of a context.
    most: tuple[int, ...] = field(default=())
    #: Per level from 2, up to the one in work.
    parts: tuple[Parts, ...] = field(default=())

    def uri(self, level: int, shard: int) -> str:
        """The file of a shard of words, or of a part of a level above."""
        return f"{self.folder}/level{level}-{shard:06d}"

    def step(self) -> float:
        """Grid of log10 probabilities: 255 steps down to half the rarest word's."""
        return (np.log10(self.tokens + 0.5 * (self.words + 1) + 1) + 1) / 255

    def shard_of(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)

    def low_hash(self, shard: int) -> int:
        return -(-(shard << 32) // self.shards) << 32

    def code(self, logp: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(-logp / self.step()), 0, 255).astype(np.uint8)


class Words:
    def __init__(self, uri: str):
        a = load(uri)
        self.hashes, width = Sequence.load(a), int(a(np.int64)[0])
        self.counts = a(np.dtype(f"u{width}"))


class Level:
    """One part of a level: base and first child of each context, its backoff, and its n-grams."""

    def __init__(self, uri: str):
        a = load(uri)
        self.base, self.child, self.keys = Sequence.load(a), Sequence.load(a), Sequence.load(a)
        self.backoff, self.codes = a(np.uint8), a(np.uint8)

    def find(self, context: np.ndarray, rank: np.ndarray, ranks_too: bool) -> tuple[np.ndarray, np.ndarray]:
        """Place of each context's n-gram (-1 if there is none), and its rank among the context's.

        Contexts come in ascending order, so equal ones are looked up once and memory is read forwards.
        """
        new = np.ones(len(context), bool)
        new[1:] = context[1:] != context[:-1]
        own = np.cumsum(new) - 1
        base, end = self.base.pair(context[new])
        out, inside = np.full(len(context), -1, np.int64), np.flatnonzero(rank < (end - base)[own])
        out[inside] = self.keys.find(base[own[inside]] + rank[inside])
        if not ranks_too:
            return out, out
        return out, out - self.child.get(context[new]).astype(np.int64)[own]


@lru_cache(maxsize=4096)
def words_file(uri: str) -> Words:
    return Words(uri)


@lru_cache(maxsize=4096)
def level_file(uri: str) -> Level:
    return Level(uri)


# --- Reading a text against the levels --------------------------------------------------

@dataclass
class Tokens:
    hashes: np.ndarray
    #: Distance of each token from the begin mark of its text; the mark itself is 0.
    place: np.ndarray
    #: First entry of each text (its begin mark), and one behind the last.
    first: np.ndarray


def tokens(column: pa.Array) -> Tokens:
    """Hashes of each text's begin mark, words and end mark."""
    hashes, first = T.word_hashes(*T.text_buffers(column))
    n = np.diff(first)
    at = np.concatenate([[0], np.cumsum(n + 2)])
    out = np.empty(at[-1], np.uint64)
    text = np.repeat(np.arange(len(n)), n)
    out[np.arange(len(hashes)) + 2 * text + 1] = hashes
    out[at[:-1]], out[at[1:] - 1] = BEGIN, END
    return Tokens(out, np.arange(at[-1]) - np.repeat(at[:-1], n + 2), at)


class Walk:
    """Log probabilities of every token of some texts, level by level."""

    def __init__(self, plan: Plan, t: Tokens):
        self.plan, self.t = plan, t
        self.shard = plan.shard_of(t.hashes)
        n = len(t.hashes)
        self.word, self.count = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        for s, rows in by_shard(self.shard, np.arange(n)):
            file = words_file(plan.uri(1, s))
            at = file.hashes.find(t.hashes[rows] - np.uint64(plan.low_hash(s)))
            known = rows[at >= 0]
            self.word[known] = at[at >= 0]
            self.count[known] = file.counts[at[at >= 0]]
        number = np.array(plan.first_word, np.int64)[self.shard] + self.word
        self.base = np.log10((self.count + 0.5) / (plan.tokens + 0.5 * (plan.words + 1)))
        self.logp = self.base.copy()
        #: Place of the context of the next level in its shard, and rank of the token under it.
        self.context, self.rank = self.shifted(self.word), np.where(self.word >= 0, number, -1)
        self.level = 1

    def shifted(self, a: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1, np.int64)
        out[1:] = a[:-1]
        out[self.t.place == 0] = -1
        return out

    def rows(self, level: int) -> np.ndarray:
        """Tokens whose text holds an n-gram of this level that ends with them."""
        return np.flatnonzero(self.t.place >= level - 1)

    def up(self) -> None:
        """Looks up the next level: probabilities, and contexts and ranks for the one after."""
        self.level += 1
        k, step = self.level, self.plan.step()
        found, rank = np.full(len(self.word), -1, np.int64), np.full(len(self.word), -1, np.int64)
        rows = self.rows(k)
        rows = rows[self.context[rows] >= 0]
        shard = np.zeros(len(self.word), np.int64)
        shard[k - 1:] = self.shard[:len(self.shard) - k + 1]
        rows = rows[np.argsort((shard[rows] << 40) | self.context[rows])]
        parts = self.plan.parts[k - 2]
        owner = np.zeros(len(self.word), np.int64)
        owner[rows] = parts.find(shard[rows], self.context[rows])
        for s, part in by_shard(owner, rows):
            file, context = level_file(self.plan.uri(k, s)), self.context[part] - parts.context[s]
            self.logp[part] -= step * file.backoff[context]
            seen = np.flatnonzero(self.rank[part] >= 0)
            at, ranks = file.find(context[seen], self.rank[part[seen]].astype(np.uint64), k < self.plan.order)
            hit = np.flatnonzero(at >= 0)
            own = part[seen[hit]]
            self.logp[own] = -step * file.codes[at[hit]]
            found[own] = at[hit] + parts.gram[s]
            rank[own] = ranks[hit]
        self.context, self.rank = self.shifted(found), rank


# --- Building ---------------------------------------------------------------------------

def pack_block(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, by byte plane, and counts, compressed."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    planes = np.ascontiguousarray(squeeze(gaps).view(np.uint8).reshape(len(keys), squeeze(gaps).dtype.itemsize).T)
    n = squeeze(counts)
    head = np.array([len(keys), planes.shape[0], n.dtype.itemsize], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + planes.tobytes() + n.tobytes())


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, width, size = np.frombuffer(raw, np.int64, 3)
    planes = np.frombuffer(raw, np.uint8, n * width, 24).reshape(width, n)
    gaps = np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.uint64)
    return np.cumsum(gaps, dtype=np.uint64), np.frombuffer(raw, f"<u{size}", n, 24 + n * width).astype(np.int64)


def tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


def key_bits(plan: Plan, level: int) -> tuple[int, int]:
    """Bits of context and rank in a counted key; a byte for the lower level's probability follows."""
    contexts = max(plan.parts[level - 2].contexts, default=1)
    ranks = plan.words + 1 if level == 2 else plan.most[level - 3]
    bits = max(1, int(contexts).bit_length()), max(1, int(ranks).bit_length())
    if sum(bits) + 8 > 64:
        raise ValueError("a part's n-grams do not fit 64-bit keys: use more shards")
    return bits


def counter(plan: Plan, level: int):
    """Counts the texts' n-grams of a level and sends each part its own, a few million at a time."""

    def emit(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        shard, keys = (np.concatenate([h[i] for h in held]) for i in range(2))
        out_shard, out_block = [], []
        for s, rows in by_shard(shard, np.arange(len(shard))):
            out_shard.append(s)
            out_block.append(pack_block(*tally(keys[rows])))
        yield pa.RecordBatch.from_arrays([pa.array(out_shard, pa.int32()), pa.array(out_block, pa.binary())], names=["shard", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in T.blocks(batches, "text"):
            t = tokens(batch.column(0))
            if level == 1:
                rows = np.flatnonzero(t.place > 0)
                held.append((plan.shard_of(t.hashes[rows]), t.hashes[rows]))
            else:
                walk = Walk(plan, t)
                for _ in range(2, level):
                    walk.up()
                rows = walk.rows(level)
                _, ranks = key_bits(plan, level)
                parts = plan.parts[level - 2]
                owner = parts.find(walk.shard[rows - level + 1], walk.context[rows])
                context = (walk.context[rows] - np.array(parts.context, np.int64)[owner]).astype(np.uint64)
                key = ((context << np.uint64(ranks)) | walk.rank[rows].astype(np.uint64)) << np.uint64(8)
                held.append((owner, key | plan.code(walk.logp[rows]).astype(np.uint64)))
            if sum(len(h[1]) for h in held) >= FLUSH:
                yield from emit(held)
                held = []
        if held:
            yield from emit(held)
    return run


def fold(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts added up."""
    keys, counts = (np.concatenate([p[i] for p in parts]) for i in range(2))
    parts.clear()
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def merged(batches: Iterator[pa.RecordBatch]) -> tuple[int | None, np.ndarray, np.ndarray]:
    """The keys and counts of one shard or part."""
    shard, parts, held, limit = None, [], 0, FOLD
    for batch in batches:
        for s, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            shard = s
            if block.is_valid:
                parts.append(unpack_block(block.as_buffer()))
                held += len(parts[-1][0])
            if held > limit:
                parts = [fold(parts)]
                held = len(parts[0][0])
                limit = max(FOLD, 2 * held)
    if not parts:
        return shard, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return shard, *fold(parts)


def cuts(counts: np.ndarray, tokens: int) -> list[int]:
    """Where to cut n-grams so that those between two cuts occur `tokens` times at most, unless they are one."""
    out, total, at = [], np.cumsum(counts, dtype=np.int64), 0
    while True:
        before = int(total[at - 1]) if at else 0
        at = max(at + 1, int(np.searchsorted(total, before + tokens, side="right")))
        if at >= len(total):
            return out
        out.append(at)


REPORT = "shard int, grams long, tokens long, children long, once long, twice long, cuts array<long>"


def report(shard: int, *counts: int, cuts: list[int] | tuple = ()) -> pa.RecordBatch:
    names = [c.split()[0] for c in REPORT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *[pa.array([c], pa.int64()) for c in counts],
                                       pa.array([list(cuts)], pa.list_(pa.int64()))], names=names)


def word_builder(plan: Plan, part_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, counts = merged(batches)
        if shard is None:
            return
        if shard == plan.shard_of(np.array([BEGIN]))[0]:  # the begin mark is a context, never a counted token
            at = np.searchsorted(keys, BEGIN)
            keys, counts = np.insert(keys, at, BEGIN), np.insert(counts, at, 0)
        low = plan.low_hash(shard)
        places = cuts(counts, part_tokens)
        counts = squeeze(counts)
        sequence = Sequence.of(keys - np.uint64(low), plan.low_hash(shard + 1) - low)
        save(plan.uri(1, shard), [*sequence.parts(), np.array([counts.dtype.itemsize], np.int64), counts])
        yield report(shard, len(keys), int(counts.sum(dtype=np.int64)), 0, 0, 0, cuts=places)
    return run


def merger(plan: Plan, level: int, part_tokens: int):
    """Sets a part's counted keys down, and reports how many occur once and twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, counts = merged(batches)
        if shard is not None:
            write_file(plan.uri(level, shard) + ".counts", [pack_block(keys, counts)])
            yield report(shard, len(keys), int(counts.sum()), 0, int((counts == 1).sum()), int((counts == 2).sum()),
                         cuts=cuts(counts, part_tokens))
    return run


def level_builder(plan: Plan, level: int, discount: float):
    """Writes a part of a level from its counts. A task that runs again finds the level written."""
    def build_one(shard: int) -> tuple[int, int, int]:
        uri = plan.uri(level, shard)
        if exists(uri):
            done = Level(uri)
            delete_file(uri + ".counts")
            children = done.child.get(np.arange(done.child.n)).astype(np.int64)
            return done.keys.n, 0, int(np.diff(children).max(initial=0))
        keys, counts = unpack_block(bytes(map_file(uri + ".counts")))
        _, bits = key_bits(plan, level)
        lower = 10.0 ** (-plan.step() * (keys & np.uint64(255)).astype(float))
        keys = keys >> np.uint64(8)
        context, rank = (keys >> np.uint64(bits)).astype(np.int64), keys & np.uint64((1 << bits) - 1)
        below = plan.parts[level - 2].contexts[shard]
        children = np.bincount(context, minlength=below)
        total = np.bincount(context, counts, minlength=below)
        backoff = np.where(total > 0, discount * children / np.maximum(total, 1), 1.0)
        # The discounted share is spread as the grid stores it, so that seen and unseen words agree.
        coded = plan.code(np.log10(backoff))
        spread = 10.0 ** (-plan.step() * coded.astype(float))
        p = np.maximum(counts - discount, 0) / total[context] + spread[context] * lower
        last = np.cumsum(children) - 1
        width = np.zeros(below, np.uint64)
        some = children > 0
        width[some] = rank[last[some]] + ONE
        base = np.concatenate([[np.uint64(0)], np.cumsum(width, dtype=np.uint64)])
        child = np.concatenate([[0], np.cumsum(children)]).astype(np.uint64)
        top = int(base[-1]) + 1
        save(uri, [
            *Sequence.of(base, top).parts(), *Sequence.of(child, len(keys) + 1).parts(),
            *Sequence.of(base[context] + rank, top).parts(), coded, plan.code(np.log10(np.minimum(p, 1.0)))])
        delete_file(uri + ".counts")
        return len(keys), int(counts.sum()), int(children.max(initial=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                yield report(shard, *build_one(shard), 0, 0)
    return run


def build(texts: DataFrame, order: int = ORDER, shard_bytes: int = SHARD_BYTES, folder: str | None = None,
          part_tokens: int = PART_TOKENS) -> Plan:
    """Trains on `texts` (text) and writes the levels; a shard stands for about `shard_bytes` of text."""
    spark = texts.sparkSession
    ship_package(spark)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plan = Plan(folder or fresh_path(spark, "trie"), max(1, -(-size // shard_bytes)), order)
    for level in range(1, order + 1):
        n = plan.shards if level == 1 else len(plan.parts[-1].shard)
        counted = texts.select("text").mapInArrow(counter(plan, level), "shard int, block binary")
        every = spark.range(n).select(F.col("id").cast("int").alias("shard"), F.lit(None).cast("binary").alias("block"))
        builder = word_builder(plan, part_tokens) if level == 1 else merger(plan, level, part_tokens)
        rows = materialise(counted.union(every).repartitionById(n, F.col("shard")).mapInArrow(builder, REPORT), "levels")
        done = sorted(rows.collect(), key=lambda r: r["shard"])  # one row of counts per part
        grams, places = [r["grams"] for r in done], [r["cuts"] for r in done]
        if level == 1:
            first = np.concatenate([[0], np.cumsum(grams)])
            plan = replace(plan, tokens=sum(r["tokens"] for r in done), words=int(first[-1]) - 1, first_word=tuple(first.tolist()),
                           parts=(Parts.of(list(range(n)), [0] * n, grams, places),))
            continue
        once, twice = (sum(r[c] for r in done) for c in ("once", "twice"))
        discount = once / (once + 2 * twice) if once and twice else 0.5
        shards = rows.select("shard").repartitionById(n, F.col("shard"))
        built = materialise(shards.mapInArrow(level_builder(plan, level, discount), REPORT), "levels").agg(F.max("children")).first()
        here = plan.parts[-1].counted(grams)
        plan = replace(plan, most=(*plan.most, built[0]), parts=(*plan.parts[:-1], here, *(
            [Parts.of(list(here.shard), list(here.gram), grams, places)] if level < order else [])))
    return plan


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scorer(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.blocks(batches, "text", 2 * T.BLOCK_BYTES):
            walk = Walk(plan, tokens(batch.column(2)))
            for _ in range(2, plan.order + 1):
                walk.up()
            real = walk.t.place > 0
            first = walk.t.first[:-1]

            def total(x):
                return np.add.reduceat(np.where(real, x, 0), first)

            n = np.diff(walk.t.first) - 1
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(total(walk.count > 0).astype(np.int64)),
                pa.array(np.full(len(n), plan.tokens, np.int64)), pa.array(total(walk.base)), pa.array(total(walk.logp))],
                names=[c.split()[0] for c in SCORES.split(", ")])
    return run


def score(docs: DataFrame, order: int = ORDER, folds: int = 5, held_fold: int = 1, shard_bytes: int = SHARD_BYTES,
          part_tokens: int = PART_TOKENS) -> DataFrame:
    """Scores every row of docs (doc_id, text) by a model of those whose crc32(doc_id) mod folds is not held_fold."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == held_fold
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    plan = build(rows.filter(~F.col("held_out")).select("text"), order, shard_bytes, part_tokens=part_tokens)
    return rows.mapInArrow(scorer(plan), SCORES)
