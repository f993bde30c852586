"""Lookup join that broadcasts only what it has counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000
# A key is hot from this share of the facts on, so there are at most as many hot keys.
HOT_SHARE = 1 / 256
TRACKED_KEYS = 10_000


def fits_broadcast(dim: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Counts at most `rows + 1` rows of `dim`."""
    return dim.limit(rows + 1).count() <= rows


def hot_keys(facts: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Non-null keys that hold at least `share` of the rows, from one pass with a frequency sketch.

    The sketch may be off near the limit, which moves work between two ways to
    join a key and changes no result.
    """
    most = int(1 / share)
    row = facts.agg(F.count("*").alias("rows"),
                    F.expr(f"approx_top_k(`{key}`, {most}, {TRACKED_KEYS})").alias("top")).first()
    return [t["item"] for t in row["top"] if t["item"] is not None and t["count"] >= row["rows"] * share]


def lookup_join(facts: DataFrame, dim: DataFrame, key: str,
                broadcast_rows: int = BROADCAST_ROWS, share: float = HOT_SHARE) -> DataFrame:
    """Left-joins `facts` to a `dim` with unique keys.

    A dimension of at most `broadcast_rows` rows is broadcast. Next to a larger one
    the facts are split: rows of hot keys, and of none, meet a broadcast of just the
    hot keys' entries and stay where they are; only the others are shuffled, and no
    key among them holds more than `share` of the rows. A stream's keys cannot be counted
    ahead, so its batches meet a large dimension in a plain join.
    """
    if fits_broadcast(dim, broadcast_rows):
        return facts.join(F.broadcast(dim), key, "left")
    if facts.isStreaming:
        return facts.join(dim, key, "left")
    hot = hot_keys(facts, key, share)
    stays = F.col(key).isNull() | F.col(key).isin(hot)
    # One entry per hot key: at most 1 / share rows.
    entries = dim.filter(F.col(key).isin(hot))
    return facts.filter(~stays).join(dim, key, "left").unionByName(
        facts.filter(stays).join(F.broadcast(entries), key, "left"))
