"""From fine cells to coarse ones: block statistics, pyramids and overlap weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: statistic -> aggregate; all skip missing cells, and a block without any is missing.
STATISTICS = {
    "sum": F.sum,
    "area_weighted_mean": F.avg,
    "fraction": F.avg,
    "median": F.median,
    "maximum": F.max,
    "any": F.max,
    "minimum": F.min,
    "mode": lambda c: F.mode(c, deterministic=True),  # the lowest value wins ties
}


def block(name: str, factor: int) -> Column:
    """Coarse coordinate of a fine one; floor keeps negative offsets aligned."""
    return F.floor(F.col(name) / factor).cast("long").alias(name)


def aggregate(cells: DataFrame, factor: int, statistic: str) -> DataFrame:
    return cells.groupBy(block("row", factor), block("col", factor)).agg(STATISTICS[statistic]("value").alias("value"))


def nearest(cells: DataFrame, ratio: float) -> DataFrame:
    """Coarse to fine with a constant: every fine cell takes the value of the cell that holds its centre (ratio: fine cells a side)."""
    step = F.sequence(F.lit(0), F.lit(int(ratio) - 1))
    return cells.select((F.col("row") * int(ratio)).alias("r"), (F.col("col") * int(ratio)).alias("c"), "value").withColumn("i", F.explode(step)).withColumn("j", F.explode(step)).select((F.col("r") + F.col("i")).alias("row"), (F.col("c") + F.col("j")).alias("col"), "value")


def overlap(cells: DataFrame, ratio: float, extensive: bool) -> DataFrame:
    """Resample to cells ratio times as large by overlap area: sums of shares (extensive) or area-weighted means.

    Each fine cell meets a bounded number of coarse ones, so targets are made from it and no range join is needed.
    """
    rows = cells.where("value IS NOT NULL")
    for name in ("row", "col"):
        low, high = F.floor(F.col(name) / ratio), F.ceil((F.col(name) + 1) / ratio) - 1
        rows = rows.withColumn(f"to_{name}", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    share = lambda n: F.greatest(F.lit(0.0), F.least(F.col(n) + 1.0, (F.col(f"to_{n}") + 1) * ratio) - F.greatest(F.col(n).cast("double"), F.col(f"to_{n}") * ratio))
    rows = rows.withColumn("w", share("row") * share("col")).where("w > 1e-9")
    total = F.sum(F.col("value") * F.col("w"))
    return rows.groupBy(F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg((total if extensive else total / F.sum("w")).alias("value"))


def pyramid(cells: DataFrame, levels: int, statistic: str) -> DataFrame:
    """level, row, col, value for levels 1.. by factors of two, each from the one before (means of means)."""
    out, now = None, cells.select("row", "col", "value")
    for k in range(1, levels + 1):
        now = aggregate(now, 2, statistic)
        rows = now.withColumn("level", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return out


#: What a coarse cell shows of each surface: whether any fine cell is chosen (255: none is valid), the most, the mean.
SURFACES = {
    "decision": lambda v: F.when(F.max(v == 1), 1).when(F.max(v != 255), 0).otherwise(255),
    "allocation": F.max,
    "priority": F.avg,
}


def overviews(cells: DataFrame, surface: str, largest: int, save) -> DataFrame:
    """level, row, col, value: halved while either side has more than largest cells, each level from the one before, which
    save(df) writes to shared storage. NaN is missing; cells are counted from 0."""
    value = F.col("value") if surface == "decision" else F.when(~F.isnan("value"), F.col("value"))
    now, out, level = cells.select("row", "col", value.alias("value")), None, 0
    top = now.agg(F.greatest(F.max("row"), F.max("col"))).first()[0]
    side = (0 if top is None else int(top)) + 1
    while side > largest:
        level, side = level + 1, (side + 1) // 2
        now = save(now.groupBy(block("row", 2), block("col", 2)).agg(SURFACES[surface](F.col("value")).alias("value")))
        rows = now.withColumn("level", F.lit(level))
        out = rows if out is None else out.unionByName(rows)
    return now.withColumn("level", F.lit(0)).limit(0) if out is None else out


def pick_overview(factors: list[int], ratio: float) -> int:
    """The first factor that is large enough, else the coarsest."""
    return min((f for f in factors if f >= -(-ratio // 1)), default=max(factors))
