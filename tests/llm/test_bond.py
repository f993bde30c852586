"""Hard negatives against plain inner products of all pairs."""

import math
import random

import numpy as np
import pytest

from flowkeel.llm import bond
from tests.llm.odd import bag

SCHEMA = "vec_id long, embedding array<float>, label int, anchor_id long, q string, rank string, block long, extra string, one string, x int"


def plain(data, every=50):
    one = {}
    for i, v, label in data:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v])
        one[i] = min(one.get(i, row), row)
    out = []
    for a, (label, q) in one.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, w, strict=False)), i, other) for i, (other, w) in one.items() if i != a)
        for s, p, _ in [r for r in scored if r[2] == label][:5]:
            fits = [r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits)]
    return sorted(out, key=repr)


def mined(spark, data):
    rows = [(*r, 1, "q", "r", 2, "e", "o", 3) for r in data]
    return bag(bond.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), 50, bond.moved_label()))


def vectors(seed, n, dims=24, coarse=False):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(dims)] for _ in range(10)]
    return [(i, [round(c + rng.gauss(0, 0.15), 1 if coarse else 6) for c in centres[i * 7 % 10 if rng.random() < 0.8 else 0]], i * 7 % 10) for i in range(n)]


@pytest.mark.parametrize("coarse", [False, True])
def test_all_pairs(spark, monkeypatch, coarse):
    data = vectors(4, 700, coarse=coarse)
    expected = plain(data)
    assert len(expected) > 50 and mined(spark, data) == expected


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(bond, "SEGMENT_ROWS", 50)
    monkeypatch.setattr(bond, "ANCHOR_ROWS", 2)
    data = vectors(5, 400)
    assert mined(spark, data) == plain(data)


def test_odd_rows(spark):
    data = vectors(6, 160, 5, True)
    data += [data[0], data[50], (50, [0.5] * 5, 3), (None, [0.1] * 5, 1), (500, None, 1), (501, [0.1] * 5, None), (502, [0.1, None, 0.2, 0.1, 0.1], 2),
             (503, [float("nan")] * 5, 1), (504, [float("inf"), 0.0, 0.0, 0.0, 0.0], 1), (550, [], 1), (600, [0.0] * 5, 2), (650, [0.3, 0.2], 4), (700, [0.2] * 9, 5)]
    assert mined(spark, data) == plain(data)


@pytest.mark.parametrize("keep", [lambda r: False, lambda r: r[0] == 0, lambda r: r[0] % 10 == 0, lambda r: r[0] % 50])
def test_few_rows(spark, keep):
    data = [r for r in vectors(7, 120) if keep(r)]
    assert mined(spark, data) == plain(data)


def test_large_numbers(spark):
    big = [(i, [float(2**20 * (i % 5 + 1)), float(i)], i % 2) for i in range(0, 120, 5)]
    assert mined(spark, big) == plain(big)
    with pytest.raises(Exception, match="beyond 64 bits"):
        mined(spark, [(0, [1e30], 1), (1, [1e30], 1)])


def test_scan_reads_large_magnitudes_first_and_drops_rows():
    rng = np.random.default_rng(1)
    columns = rng.integers(-100, 100, (64, 5000)).astype(np.float64)
    query = np.where(np.arange(64) % 8 == 0, 100.0, 1.0)
    left = []

    def keep(partial, low, high):
        left.append(len(partial))
        return bond.keep_best(5)(partial, low, high)

    rows, scores = bond.scan(query, columns, columns.min(axis=1), columns.max(axis=1), np.ones(5000, bool), keep)
    exact = query @ columns
    assert left[1] < 2000 and list(scores) == list(exact[rows])
    assert set(np.argsort(-exact)[:5]) <= set(rows)
