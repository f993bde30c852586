"""Ranked search against plain scoring of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from flowkeel.llm import hybrid
from tests.llm.odd import bag, documents, lower, rows


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute(docs, items, k=10):
    sets = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in sets]
    n_docs, n_terms = sum(1 for n in sizes if n), sum(sizes)
    df = Counter(t for _, c in sets for t in c)
    out = []
    for item, text in items:
        scored = []
        for (i, c), n in zip(sets, sizes, strict=True):
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // n_terms)))
                    for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def zipf(seed, n, longest=400, of=300):
    rng = random.Random(seed)
    weights = [1 / (j + 1) for j in range(of)]
    return [(i, " ".join(f"T{j}" for j in rng.choices(range(of), weights, k=rng.randrange(1, longest)))) for i in range(n)]


def frames(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"))


def test_odd_documents_and_items(spark):
    data = [(r[0], r[1]) for r in rows()]
    items = [(1, "w1 W2 w3 w3 other12"), (1, "w1 W2 w3 w3 other12"), (None, "漢字 é one"), (3, None), (4, ""), (5, "nowhere"), (6, "x" * 5000), (7, "one two"), (8, data[0][1])]
    got = hybrid.search(hybrid.build(documents(spark)), spark.createDataFrame([(i, t, "x", 9) for i, t in items], "item_id long, text string, item string, rank int"))
    assert bag(got) == brute(data, items)


@pytest.mark.parametrize("seed", [1, 2])
def test_many_documents(spark, monkeypatch, seed):
    docs, items = zipf(seed, 1500), [(i, t) for i, t in zipf(seed + 10, 25, 40)]
    items += [(100, "t0"), (101, "t0 t1 t2"), (102, "t299 t0")]
    d, i = frames(spark, docs, items)
    got = hybrid.search(hybrid.build(d), i)
    assert bag(got) == brute(docs, items)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(hybrid, "BLOCK_ITEMS", 3)
    docs, items = zipf(5, 200), zipf(6, 10, 20)
    assert bag(hybrid.search(hybrid.build(frames(spark, docs, items)[0]), frames(spark, docs, items)[1], 3)) == brute(docs, items, 3)


def test_empty_tables(spark):
    d, i = frames(spark, zipf(1, 5), zipf(2, 3))
    assert hybrid.search(hybrid.build(d.limit(0)), i).count() == 0
    assert hybrid.search(hybrid.build(d), i.limit(0)).count() == 0


def one_segment(docs):
    batch = pa.record_batch({"doc_id": pa.array([i for i, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string())})
    (found,) = hybrid.segments(iter([batch]))
    return found.to_pylist()[0]


def test_walk_skips_what_cannot_be_among_the_best(monkeypatch):
    # One document of the first range holds a rare term many times; the frequent term alone cannot reach it.
    docs = [(i, "rare " * 50 + "common" if i < 10 else "common filler" * 3) for i in range(9000)]
    row = one_segment(docs)
    total = sum(len(terms(t)) for _, t in docs)
    segment = hybrid.Segment(row, len(docs), total)
    read = []
    plain = hybrid.Segment.part
    monkeypatch.setattr(hybrid.Segment, "part", lambda self, k, lo, hi, w: read.append(hi - lo) or plain(self, k, lo, hi, w))
    asked = np.unique(hybrid.terms(pa.array(["rare common"]))[0])
    at = np.searchsorted(segment.terms, asked)
    found, scores = hybrid.search_segment(segment, at, hybrid.term_weights(segment.dfs[at].astype(np.int64), len(docs)) + 1, 10)
    assert list(found) == list(range(10)) and sum(read) < 100 and len(scores) == 10


def test_block_bounds_hold():
    docs = zipf(9, 700)
    row = one_segment(docs)
    segment = hybrid.Segment(row, 700, sum(len(terms(t)) for _, t in docs))
    for k in range(len(segment.terms)):
        gains = segment.part(k, 0, int(segment.dfs[k]), 1)[1]
        tops = segment.top[segment.first_block[k]:segment.first_block[k + 1]]
        assert len(tops) == -(-len(gains) // hybrid.BLOCK)
        assert all(gains[j * hybrid.BLOCK:(j + 1) * hybrid.BLOCK].max() <= tops[j] for j in range(len(tops)))


def test_segments_are_files_that_tasks_map(spark, tmp_path):
    """Rows of the index only name segments: their lists never pass through the JVM, however large they are."""
    docs = zipf(3, 300) + [(None, "T0 only"), (7, None), (8, "")]
    index = hybrid.build(frames(spark, docs, [])[0])
    assert index.dtypes == [("path", "string"), ("n_docs", "bigint"), ("n_terms", "bigint")]
    rows_ = index.collect()
    held = [hybrid.opened(r["path"]) for r in rows_]
    ids = [int(i) if k else None for h in held for i, k in zip(h["ids"], h["known"], strict=True)]
    assert sorted(ids, key=repr) == sorted((i for i, _ in docs), key=repr)
    assert sum(r["n_docs"] for r in rows_) == 301 and sum(r["n_terms"] for r in rows_) == sum(int(h["sizes"].sum()) for h in held)
    items = [(1, "t0 t5"), (2, "only")]
    found = hybrid.search(index, frames(spark, docs, items)[1])
    assert bag(found) == brute([(i, t or "") for i, t in docs], items)
