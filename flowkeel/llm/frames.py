"""DataFrame helpers of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
# The driver holds a bitmap about five times while it is collected, built, cut and kept: 8 MB of the keys' 16 bits at a time.
SIEVE_KEYS = 8_000_000


def lower_ascii(column: str) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if it has at most `rows` rows of bounded width, else unmarked."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def sieved(df: DataFrame, columns: list[str], keys: DataFrame, limit: int = SIEVE_KEYS) -> DataFrame:
    """The rows of `df` whose `columns` are among those of `keys`, and about one in 70 of the others.

    Ahead of a join it keeps most rows that find no partner out of the shuffle. The keys are sent to all tasks as two
    bits each in bitmaps of 16 bits a key. Of more than `limit` keys no bitmap is made and all rows stay.
    """
    slots = 8 * max(keys.count(), 1)
    if slots > 8 * limit:
        return df
    names = df.columns
    for seed in (1, 2):
        place = F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(slots))
        # Dealt by bitmap first, so that tasks do not each send their own copy of every bitmap.
        bits = keys.select(F.bitmap_bucket_number(place).alias("_map"), F.bitmap_bit_position(place).alias("_bit")).repartition(
            "_map").groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
        bit = F.bitmap_bit_position(place)
        byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        df = df.join(F.broadcast(bits), F.bitmap_bucket_number(place) == F.col("_map")).filter(
            F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1).select(*names)
    return df


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and text; the two first name a row up to rows that repeat it."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
