"""The language model against dictionaries, and its compact parts."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from flowkeel.llm import trie
from flowkeel.llm.compact import Sequence, pack_bits, read_bits
from tests.llm.odd import documents, rows, split


@pytest.mark.parametrize("top", [50, 10_000, 1 << 40, 1 << 64])
def test_sequence_finds_exactly_what_it_holds(top):
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, top, 700, dtype=np.uint64))
    s = Sequence.of(values, top)
    assert np.array_equal(s.get(np.arange(len(values))), values)
    ask = np.concatenate([values, rng.integers(0, top, 500, dtype=np.uint64)])
    place = np.searchsorted(values, ask)
    there = values[np.minimum(place, len(values) - 1)] == ask
    assert np.array_equal(s.find(ask), np.where(there, place, -1))


def test_sequence_with_repeats_and_empty():
    s = Sequence.of(np.array([0, 0, 5, 5, 5, 9], np.uint64), 10)
    assert s.get(np.arange(6)).tolist() == [0, 0, 5, 5, 5, 9]
    assert s.find(np.array([0, 5, 9, 1], np.uint64)).tolist() == [0, 2, 5, -1]
    assert Sequence.of(np.zeros(0, np.uint64), 10).find(np.array([3], np.uint64)).tolist() == [-1]


@pytest.mark.parametrize("bits", [0, 1, 7, 43, 64])
def test_bit_fields(bits):
    x = np.random.default_rng(2).integers(0, (1 << bits) - 1, 300, dtype=np.uint64, endpoint=True)
    assert np.array_equal(read_bits(pack_bits(x, bits), np.arange(300), bits), x)


def test_blocks_of_keys():
    keys, counts = trie.tally(np.random.default_rng(3).integers(0, 1 << 60, 1000, dtype=np.uint64) >> np.uint64(50))
    k, c = trie.unpack_block(trie.pack_block(keys, counts))
    assert np.array_equal(k, keys) and np.array_equal(c, counts) and c.sum() == 1000


def expected(data, order):
    def tokens(t):
        return [*split(t), None]

    def held(d):
        return zlib.crc32(str("" if d is None else d).encode()) % 5 == 1

    train = [tokens(r[1]) for r in data if not held(r[0])]
    c = [Counter() for _ in range(order + 1)]
    for t in train:
        c[1].update((w,) for w in t)
        s = ["<begin>", *t]
        for n in range(2, order + 1):
            c[n].update(tuple(s[i:i + n]) for i in range(len(s) - n + 1))
    n_train, v = sum(c[1].values()), len(c[1])
    discount, total, kinds = [0] * (order + 1), [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
    for n in range(2, order + 1):
        once, twice = (sum(1 for x in c[n].values() if x == k) for k in (1, 2))
        discount[n] = once / (once + 2 * twice) if once and twice else 0.5
        for g, x in c[n].items():
            total[n][g[:-1]] += x
            kinds[n][g[:-1]] += 1

    def p(g):
        n = len(g)
        if n == 1:
            return (c[1][g] + 0.5) / (n_train + 0.5 * (v + 1))
        low, t = p(g[1:]), total[n][g[:-1]]
        return low if not t else max(c[n][g] - discount[n], 0) / t + discount[n] * kinds[n][g[:-1]] / t * low

    out = {}
    for r in data:
        t = tokens(r[1])
        s = ["<begin>", *t]
        score = sum(math.log10(p(tuple(s[max(0, i - order + 1):i + 1]))) for i in range(1, len(s)))
        base = sum(math.log10(p((w,))) for w in t)
        out[r[0], r[1]] = (held(r[0]), len(t), sum((w,) in c[1] for w in t), n_train, base, score)
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_match_dictionaries(spark, order):
    df = documents(spark)
    want = expected(rows(), order)
    scored = trie.score(df.select("doc_id", "text", "bucket"), order=order).collect()
    assert len(scored) == len(rows())
    by_key = Counter()
    for r in scored:
        match = [w for (d, _), w in want.items() if d == r["doc_id"] and w[:4] == tuple(r)[1:5]
                 and abs(w[4] - r["base_score"]) < 1e-6 * max(1, abs(w[4])) and abs(w[5] - r["score"]) < 0.03 * r["n_tokens"] + 0.02]
        assert match, r
        by_key[r["doc_id"]] += 1
    assert by_key == Counter(r[0] for r in rows())


def test_many_shards_give_the_same_scores(spark):
    df = documents(spark)
    one = {(r[0], r[2]): r for r in trie.score(df).collect()}
    many = {(r[0], r[2]): r for r in trie.score(df, shard_bytes=4000).collect()}
    for k, r in one.items():
        assert many[k]["base_score"] == pytest.approx(r["base_score"])
        assert abs(many[k]["score"] - r["score"]) < 1e-6 * r["n_tokens"] + 1e-6


def test_a_frequent_first_word_is_dealt_to_many_parts(spark):
    df = spark.createDataFrame([(i, " ".join(f"hot a{j * 7 % 50} hot b{i * 31 + j}" for j in range(60))) for i in range(40)],
                               "doc_id long, text string").repartition(4)
    one = {r["doc_id"]: r for r in trie.score(df, order=4).collect()}
    many = {r["doc_id"]: r for r in trie.score(df, order=4, shard_bytes=8000, part_tokens=300).collect()}
    assert all(many[k]["score"] == pytest.approx(r["score"], abs=1e-6 * r["n_tokens"]) for k, r in one.items())
    plan = trie.build(df.select("text"), part_tokens=300)
    grams = [trie.Level(plan.uri(3, p)).keys.n for p in range(len(plan.parts[1].shard))]
    assert plan.shards == 1 and len(grams) > 20 and max(grams) <= 300


def test_folded_blocks_and_cuts(monkeypatch):
    monkeypatch.setattr(trie, "FOLD", 100)
    rng = np.random.default_rng(4)
    every = [rng.integers(0, 300, 200, dtype=np.uint64) for _ in range(20)]
    blocks = [trie.pack_block(*trie.tally(k)) for k in every]
    batches = [pa.RecordBatch.from_pydict({"shard": pa.array([3], pa.int32()), "block": pa.array([b], pa.binary())}) for b in blocks]
    shard, keys, counts = trie.merged(iter(batches))
    want = trie.tally(np.concatenate(every))
    assert shard == 3 and np.array_equal(keys, want[0]) and np.array_equal(counts, want[1])
    assert trie.cuts(np.array([1, 1, 9, 2, 1, 5, 0]), 4) == [2, 3, 5, 6] and trie.cuts(np.zeros(0, np.int64), 4) == []


def test_no_training_rows(spark):
    df = documents(spark, lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1)
    got = trie.score(df).collect()
    assert got and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == r["base_score"] == 0 for r in got)
    assert trie.score(documents(spark, lambda r: False)).count() == 0


def test_held_out_texts_gain_from_contexts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sums = trie.score(docs).filter("held_out").groupBy().sum("base_score", "score").first()
    assert sums[1] > sums[0]
