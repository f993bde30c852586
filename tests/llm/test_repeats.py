"""Removal of long repeats against a set of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from flowkeel.llm import rindex
from tests.llm.odd import bag, documents, rows


def brute(data, length):
    seen = Counter(b[i:i + length] for _, t, *_ in data for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = []
    for d, t, *_ in data:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def woven(seed, n, alphabet=b"abcdefgh"):
    """Texts that share passages of many lengths, with small changes, and periodic stretches."""
    rng = random.Random(seed)
    pool = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(20, 900))) for _ in range(8)]
    out = []
    for _ in range(n):
        t = bytearray()
        for _ in range(rng.randrange(1, 5)):
            p = bytearray(rng.choice(pool))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = 122
            a = rng.randrange(len(p) // 2 + 1)
            t += p[a:] + bytes(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))
        if rng.random() < 0.2:
            t += b"xyz" * rng.randrange(10, 200)
        out.append(bytes(t).decode())
    return list(enumerate(out))


@pytest.mark.parametrize(("length", "gram", "crowd"), [(40, 12, 1000), (40, 12, 1), (100, 32, 2), (17, 1, 3), (25, 25, 1000)])
def test_woven_texts(spark, length, gram, crowd):
    data = woven(length, 60)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert bag(rindex.remove_repeats(df, length, gram, crowd, shard_bytes=8000)) == brute(data, length)


def test_odd_documents(spark):
    assert bag(rindex.remove_repeats(documents(spark))) == brute(rows(), 400)
    assert bag(rindex.remove_repeats(documents(spark), 60)) == brute(rows(), 60)
    assert rindex.remove_repeats(documents(spark, lambda r: False)).count() == 0


def test_long_texts_are_cut_into_segments(spark, monkeypatch):
    rng = random.Random(9)
    long = "".join(rng.choice("abcd") for _ in range(5000))
    data = [(1, long), (2, long[700:2900] + "x"), (3, long[100:180])]
    plan = rindex.Plan("", 1, 50, 16)
    monkeypatch.setattr(rindex, "SEGMENT", 600)
    parts = list(rindex.segments(plan, np.frombuffer(long.encode(), np.uint8), np.array([0, 5000])))
    assert len(parts) > 5 and sum(int((s.last - s.first + 1).sum()) for s, _, _ in parts) == 5000 - 49
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert bag(rindex.remove_repeats(df, 50, 16)) == brute(data, 50)


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics_are_exact(seed):
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 60))) for _ in range(12)]
    strings += [strings[0], b"ab" * 20]
    data = np.frombuffer(b"".join(strings), np.uint8)
    size = np.array([len(s) for s in strings])
    first = np.concatenate([[0], np.cumsum(size)])
    end = np.repeat(first[1:], size)
    index = rindex.RunLengthIndex.of(data, first, end)
    assert int(index.length.sum()) == len(data)
    suffixes = [bytes(data[i:end[i]]) for i in range(len(data))]

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    want = [max(common(s, o) for j, o in enumerate(suffixes) if j != i) for i, s in enumerate(suffixes)]
    assert index.statistics(data, end).tolist() == want


def test_kept_text(spark):
    shared = "s" * 30 + "t" * 30
    df = spark.createDataFrame([(1, "a" + shared + "é"), (2, shared + "b")], "doc_id long, text string")
    got = {r["doc_id"]: r["kept_text"] for r in rindex.remove_repeats(df, 60, 16, texts_too=True).collect()}
    assert got == {1: "aé", 2: "b"}
