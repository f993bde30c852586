"""Exact moments and quantiles of numeric columns in a few narrow passes.

`percentile` gathers every distinct value of a column in one reducer. Here each
pass is a histogram with map-side combine and a bounded number of slots, and the
driver only learns which slot holds each wanted rank: first one of the
logarithmic slots over all rows, then one of `SLOTS` equal parts of that slot's
value range, until a slot holds a single value. A pass cuts the range to a
millionth, so 64-bit values take four passes at most, and values below 10^9 two.
The later passes filter by literal ranges, which reach the Parquet scan.

Columns of doubles are searched as 64-bit integers in the same order; their
moments come from the doubles themselves. NaN counts as missing.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowkeel.functions.stats import log_bucket
from flowkeel.session import materialise

LOG_STEPS = 1 << 10
SLOTS = 1 << 20


# Layout of a 64-bit floating-point number.
MANTISSA = 1 << 52
EXPONENT_BIAS = 1023
LEAST_NORMAL = 2.0 ** -1022
INFINITE = 0x7FF << 52


@dataclass
class Stats:
    """Moments of one column; `quantiles` maps each probability to its value."""

    n: int
    min: int
    max: int
    mean: float
    stddev: float
    quantiles: dict[float, float] = field(default_factory=dict)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def order_key(x: Column) -> Column:
    """A double's bits as an integer that ascends with it; NaN as null."""
    size = F.abs(x)
    within = F.greatest(F.least(size, F.lit(1.7976931348623157e308)), F.lit(LEAST_NORMAL))
    half = F.lit(2.0 ** 537)

    def bits(a: Column) -> Column:
        fits = F.when(a["part"] >= 2, 1).when(a["part"] < 1, -1).otherwise(0)
        part = a["part"] * F.when(a["part"] >= 2, 0.5).when(a["part"] < 1, 2.0).otherwise(1.0)
        normal = (a["e"] + fits + EXPONENT_BIAS).cast("bigint") * F.lit(MANTISSA) + ((part - 1) * F.lit(float(MANTISSA))).cast("bigint")
        return (F.when(a["size"] == F.lit(float("inf")), F.lit(INFINITE)).when(a["size"] >= LEAST_NORMAL, normal)
                .otherwise((a["size"] * half * half).cast("bigint")))

    split = _bound(F.struct(size.alias("size"), F.floor(F.log2(within)).cast("int").alias("e")), lambda a: F.struct(
        a["size"].alias("size"), a["e"].alias("e"), (a["size"] * F.pow(F.lit(2.0), -a["e"])).alias("part")))
    sign = F.when(x < 0, F.lit(-1)).otherwise(F.lit(1))
    return F.when(~F.isnan(x), sign * _bound(split, bits))


def from_key(key: int) -> float:
    value = struct.unpack("<d", struct.pack("<q", abs(key)))[0]
    return -value if key < 0 else value


def _real_columns(df: DataFrame, columns: dict[str, Column]) -> set[str]:
    types = dict(df.select(*[c.alias(m) for m, c in columns.items()]).dtypes)
    return {m for m, t in types.items() if t in ("double", "float") or t.startswith("decimal")}


def _moments(df: DataFrame, columns: dict[str, Column]) -> dict[str, tuple[float, float]]:
    """Mean and deviation of columns of doubles."""
    parts = [f(F.nanvl(c.cast("double"), F.lit(None))).alias(f"{k}{i}")
             for i, c in enumerate(columns.values()) for k, f in (("mean", F.avg), ("dev", F.stddev_pop))]
    row = df.agg(*parts).first()
    return {m: (row[f"mean{i}"], row[f"dev{i}"]) for i, m in enumerate(columns)}


def _slot_counts(rows: DataFrame, group: str) -> DataFrame:
    """Counts and bounds per slot, with the number of rows in the slots before."""
    w = Window.partitionBy(group).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.groupBy(group, "slot")
        .agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
             F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
        .withColumn("below", F.sum("n").over(w) - F.col("n"))
    )


def _holds(rank: Column) -> Column:
    return (rank >= F.col("below")) & (rank < F.col("below") + F.col("n"))


def _stacked(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select(*[c.cast("bigint").alias(m) for m, c in columns.items()]).unpivot(
        [], list(columns), "metric", "x").filter(F.col("x").isNotNull())


def _first_pass(df: DataFrame, columns: dict[str, Column], probs: Sequence[float]) -> list:
    """One row per metric: its moments, and the slots that hold its wanted ranks."""
    by_metric = Window.partitionBy("metric")
    n, mean = F.col("n"), F.col("mean")
    slots = (
        _slot_counts(_stacked(df, columns).withColumn("slot", log_bucket(F.col("x"), LOG_STEPS)), "metric")
        .withColumn("total", F.sum("n").over(by_metric))
        .withColumn("centre", F.sum(n * mean).over(by_metric) / F.col("total"))
    )
    last = F.col("total") - 1
    ranks = F.array_distinct(F.concat(
        F.array(*[F.floor(F.lit(float(p)) * last) for p in probs]),
        F.array(*[F.ceil(F.lit(float(p)) * last) for p in probs])))
    here = F.filter(ranks, _holds)
    hit = F.when(F.size(here) > 0, F.struct("lo", "hi", "below", here.alias("ranks")))
    spread = F.sum(n * (F.col("var") + (mean - F.col("centre")) ** 2)) / F.sum("n")
    return slots.groupBy("metric").agg(
        F.sum("n").alias("rows"), F.min("lo").alias("min"), F.max("hi").alias("max"),
        F.first("centre").alias("average"), F.sqrt(spread).alias("stddev"),
        F.collect_list(hit).alias("hits")).collect()


def _narrow(df: DataFrame, columns: dict[str, Column], ranges: list[tuple[str, int, int, list[int]]]) -> list:
    """Splits value ranges `(metric, lo, hi, ranks)` and finds the part that holds each rank."""
    used = {m: columns[m] for m in dict.fromkeys(r[0] for r in ranges)}
    near = reduce(lambda a, b: a | b, [columns[m].between(lo, hi) for m, lo, hi, _ in ranges])
    x, branch, slot = F.col("x"), None, None
    for i, (m, lo, hi, _) in enumerate(ranges):
        inside = (F.col("metric") == m) & x.between(lo, hi)
        part = F.call_function("div", x - F.lit(lo), F.lit((hi - lo) // SLOTS + 1))
        branch = F.when(inside, F.lit(i)) if branch is None else branch.when(inside, F.lit(i))
        slot = F.when(inside, part) if slot is None else slot.when(inside, part)
    rows = _stacked(df.filter(near), used).select("x", branch.alias("branch"), slot.alias("slot")).filter(
        F.col("branch").isNotNull())
    wanted = F.create_map(*[c for i, r in enumerate(ranges) for c in (
        F.lit(i), F.array(*[F.lit(k).cast("bigint") for k in r[3]]))])
    here = F.filter(F.element_at(wanted, F.col("branch")), _holds)
    return (_slot_counts(rows, "branch").withColumn("ranks", here).filter(F.size("ranks") > 0)
            .select("branch", "lo", "hi", "below", "ranks").collect())


def exact_stats(df: DataFrame, columns: dict[str, Column], probs: Sequence[float]) -> dict[str, Stats]:
    """Moments and linearly interpolated quantiles per metric; nulls do not count.

    `columns` maps metric names to numeric columns. A metric without values is
    missing from the result. Runs its passes at once and keeps at most two slots
    per metric and quantile in the driver.
    """
    real = _real_columns(df, columns)
    moments = _moments(df, {m: columns[m] for m in columns if m in real}) if real else {}
    if real:
        # The keys are written once, as the passes below read them several times.
        df = materialise(df.select(*[(order_key(c.cast("double")) if m in real else c).alias(m) for m, c in columns.items()]), "keys")
        columns = {m: F.col(f"`{m}`") for m in columns}
    found: dict[tuple[str, int], int] = {}
    stats: dict[str, Stats] = {}
    # (metric, lo, hi, ranks within the range, same ranks within the column)
    open_ranges = []

    def sort_in(metric, hit, outer):
        inner = [r - hit["below"] for r in hit["ranks"]]
        if hit["lo"] == hit["hi"]:
            found.update({(metric, outer(r)): hit["lo"] for r in hit["ranks"]})
        else:
            open_ranges.append((metric, hit["lo"], hit["hi"], inner, [outer(r) for r in hit["ranks"]]))

    for row in _first_pass(df, columns, probs):
        stats[row["metric"]] = Stats(row["rows"], row["min"], row["max"], row["average"], row["stddev"])
        for hit in row["hits"]:
            sort_in(row["metric"], hit, lambda r: r)
    while open_ranges:
        ranges, open_ranges = open_ranges, []
        for row in _narrow(df, columns, [r[:4] for r in ranges]):
            metric, _, _, inner, outer = ranges[row["branch"]]
            sort_in(metric, row, dict(zip(inner, outer)).__getitem__)

    for metric, s in stats.items():
        value = from_key if metric in real else int
        s.min, s.max = value(s.min), value(s.max)
        s.mean, s.stddev = moments.get(metric, (s.mean, s.stddev))
        for p in probs:
            pos = float(p) * (s.n - 1)
            lo, hi = value(found[metric, floor(pos)]), value(found[metric, ceil(pos)])
            s.quantiles[p] = float(lo) if lo == hi else lo + (hi - lo) * (pos - floor(pos))
    return stats


def approx_stats(df: DataFrame, columns: dict[str, Column], probs: Sequence[float],
                 accuracy: int = 10_000) -> dict[str, Stats]:
    """The same in one pass, with quantiles within `1 / accuracy` of their rank."""
    real = _real_columns(df, columns)
    kind = "double" if real else "bigint"
    stacked = df.select(*[F.nanvl(c.cast(kind), F.lit(None)).alias(m) if real else c.cast(kind).alias(m) for m, c in columns.items()])
    rows = stacked.unpivot([], list(columns), "metric", "x").filter(F.col("x").isNotNull()).groupBy("metric").agg(
        F.count("*").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("stddev"),
        F.percentile_approx("x", list(probs), accuracy).alias("q")).collect()
    return {r["metric"]: Stats(r["n"], r["min"], r["max"], r["mean"], r["stddev"],
                               dict(zip(probs, map(float, r["q"])))) for r in rows}
