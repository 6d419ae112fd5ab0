"""What several operators need: tables in the shared folder, bounded bitmaps, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.shared import save

#: Bits of a bitmap. Its size (1 MB) doesn't grow with the data: it only saves work, an exact join always follows.
BITS = 1 << 23
#: Bits in a bucket of Spark's bitmap functions.
BUCKET = 1 << 15


def mixed(x: np.ndarray) -> np.ndarray:
    """Place of a long in a bitmap, as placed() gives it."""
    x = x.view(np.uint64)
    return ((x ^ (x >> np.uint64(23)) ^ (x >> np.uint64(46))) & np.uint64(BITS - 1)).astype(np.int64)


def placed(column: str) -> Column:
    x = F.col(column)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 23)).bitwiseXOR(F.shiftrightunsigned(x, 46)).bitwiseAND(F.lit(BITS - 1).cast("long"))


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """Which of BITS places the values of a long column take. 256 rows of 4 kB reach the driver, whatever the input."""
    place = placed(column)
    rows = df.select(F.shiftright(place, 15).alias("b"), place.bitwiseAND(F.lit(BUCKET - 1).cast("long")).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()
    bits = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        bits[r.b * (BUCKET // 8) : (r.b + 1) * (BUCKET // 8)] = np.frombuffer(bytes(r.m), np.uint8)
    return bits


def among(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each long may be among the values that the bitmap was made of (never false for one that is)."""
    place = mixed(x)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of edges (a, b: long), self links allowed.

    Large-star and small-star rounds (Kiveris et al. 2014); each round is a table in the shared folder. Empty edges
    give an empty result. Nulls must have been dropped.
    """
    names, edges = edges.columns, save(edges)
    e = edges.select(F.greatest(*names).alias("u"), F.least(*names).alias("v"))
    alone = e.where("u = v").select("u", "v")
    e, seen = save(e.where("u <> v").distinct()), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        e = save(e.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), "v")).unionByName(alone).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
