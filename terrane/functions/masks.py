"""Bit-packed masks: little-endian bits of 0-based positions, as base64 with a checksum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions in one of Spark's bitmaps.
SPAN = 32768


def pack(positions: DataFrame, group: list[str]) -> DataFrame:
    """group columns, chunk, mask (base64), sha256 and bits set, of the positions (0-based, long) in each group."""
    chunk = F.floor(F.col("position") / SPAN).alias("chunk")
    rows = positions.groupBy(*group, chunk).agg(F.bitmap_construct_agg(F.col("position") % SPAN).alias("bitmap"))
    return rows.select(*group, "chunk", F.base64("bitmap").alias("mask"), F.sha2("bitmap", 256).alias("sha256"), F.bitmap_count("bitmap").alias("bits"))


def unpack(mask: str) -> Column:
    """Array of the positions set in a base64 mask (a column's name); NULL for NULL."""
    hexed = F.hex(F.unbase64(mask))
    byte = lambda k: F.conv(F.substring(hexed, k * 2 + 1, F.lit(2)), 16, 10).cast("int")
    last = (F.length(hexed) / 2 - 1).cast("int")
    bits = F.transform(F.sequence(F.lit(0), last), lambda k: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.when(F.getbit(byte(k), j) == 1, k * 8 + j)))
    return F.array_compact(F.flatten(bits))
