"""From the cells of one map projection to those of another, by the area that their images share.

Every source cell becomes a polygon in the cells of the destination (corners, and points between them where edges bend),
finds the destination cells in its bounds and shares its area out among them. A polygon's part in a cell is the sum over
its edges of the area between the edge, held within the cell, and the cell's lower side, so clipping is arithmetic on
columns. Each source cell makes its own targets: no range join, no halo. Missing values have no part in anything.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Projection = Callable[[Column, Column], tuple[Column, Column]]


@dataclass(frozen=True)
class Frame:
    """A raster: its left and upper edge, the side of its cells, and its numbers of rows and columns."""

    left: float
    top: float
    size: float
    height: int
    width: int


def _part(ax: Column, ay: Column, bx: Column, by: Column, col: Column, row: Column) -> Column:
    """Signed area between an edge and the lower side of the unit cell at (col, row), within the cell."""
    low, high = col.cast("double"), col + 1.0
    x0, x1 = F.least(F.greatest(ax, low), high), F.least(F.greatest(bx, low), high)
    slope = (by - ay) / F.nullif(bx - ax, F.lit(0.0))
    y0, y1 = ay + slope * (x0 - ax) - row, ay + slope * (x1 - ax) - row  # heights in the cell, not held yet
    # antiderivative of the height held between 0 and 1
    upto = lambda y: F.when(y <= 0, 0.0).when(y >= 1, y - 0.5).otherwise(y * y / 2)
    held = lambda y: F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0))
    flat = F.abs(y1 - y0) < 1e-7
    return F.when((bx == ax) | (x0 == x1), 0.0).when(flat, (held(y0) + held(y1)) / 2 * (x1 - x0)).otherwise((upto(y1) - upto(y0)) / F.nullif(slope, F.lit(0.0)))


def shares(cells: DataFrame, source: Frame, target: Frame, project: Projection, bends: int = 1) -> DataFrame:
    """row, col (of the target), value, area (shared, in target cells), whole (of the source cell) of all cells with a value.

    project: from the source's coordinates to the target's. bends: straight pieces that an edge is made of.
    """
    corners = [(0, 0), (1, 0), (1, 1), (0, 1)]
    outline = [(a[0] + (b[0] - a[0]) * k / bends, a[1] + (b[1] - a[1]) * k / bends) for a, b in zip(corners, [*corners[1:], corners[0]], strict=True) for k in range(bends)]
    points = []
    for dx, dy in outline:
        x, y = project(F.lit(source.left) + (F.col("col") + dx) * source.size, F.lit(source.top) - (F.col("row") + dy) * source.size)
        points.append(F.struct(((x - target.left) / target.size).alias("x"), ((target.top - y) / target.size).alias("y")))
    rows = cells.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))).select("row", "col", "value", F.array(*points).alias("p"))
    of = lambda f, k: f(F.transform("p", lambda q: q[k]))
    spans = {"c": ("x", target.width), "r": ("y", target.height)}
    for name, (k, most) in spans.items():
        first, last = F.greatest(F.floor(of(F.array_min, k)), F.lit(0)).cast("long"), F.least(F.ceil(of(F.array_max, k)) - 1, F.lit(most - 1)).cast("long")
        rows = rows.withColumns({f"{name}0": first, f"{name}1": last})
    after = F.concat(F.slice("p", F.lit(2), F.size("p") - 1), F.slice("p", 1, 1))
    edges = F.zip_with("p", after, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    rows = rows.where("c0 <= c1 AND r0 <= r1").withColumn("e", edges)
    whole = F.abs(F.aggregate("e", F.lit(0.0), lambda s, e: s + (e["bx"] - e["ax"]) * (e["by"] + e["ay"]) / 2))
    rows = rows.select("value", "e", whole.alias("whole"), "r0", "r1", F.explode(F.sequence("c0", "c1")).alias("c")).select("value", "e", "whole", "c", F.explode(F.sequence("r0", "r1")).alias("r"))
    area = F.abs(F.aggregate("e", F.lit(0.0), lambda s, e: s + _part(e["ax"], e["ay"], e["bx"], e["by"], F.col("c"), F.col("r"))))
    return rows.select(F.col("r").alias("row"), F.col("c").alias("col"), "value", area.alias("area"), "whole").where("area > 1e-9")


def warp(cells: DataFrame, source: Frame, target: Frame, project: Projection, statistic: str, bends: int = 1) -> DataFrame:
    """row, col, value of the target's cells that meet any value.

    sum: each cell's value by the share of it; area_weighted_mean, fraction: means by area; mode: the value of most area,
    the lowest on ties; median: the lowest value that half of the area doesn't exceed; maximum, any, minimum: of all that
    share any area.
    """
    rows = shares(cells, source, target, project, bends)
    keys, w = ["row", "col"], F.col("area")
    if statistic in ("mode", "median"):
        by_value = rows.groupBy(*keys, "value").agg(F.sum("area").alias("area"))
        if statistic == "mode":
            best = F.max_by("value", F.struct(F.round("area", 9), -F.col("value")))
            return by_value.groupBy(*keys).agg(best.alias("value"))
        upto = F.sum("area").over(Window.partitionBy(*keys).orderBy("value"))
        half = F.sum("area").over(Window.partitionBy(*keys)) / 2
        return by_value.withColumns({"upto": upto, "half": half}).where(F.col("upto") >= F.col("half") - 1e-9).groupBy(*keys).agg(F.min("value").alias("value"))
    simple = {
        "sum": F.sum(F.col("value") * w / F.col("whole")),
        "area_weighted_mean": F.sum(F.col("value") * w) / F.sum(w),
        "fraction": F.sum(F.col("value") * w) / F.sum(w),
        "maximum": F.max("value"),
        "any": F.max("value"),
        "minimum": F.min("value"),
    }
    if statistic not in simple:
        raise ValueError(f"no statistic {statistic}")
    return rows.groupBy(*keys).agg(simple[statistic].alias("value"))


def extensive(cells: DataFrame, source: Frame, target: Frame, project: Projection, bends: int = 1) -> DataFrame:
    """Coarse to fine of amounts: the mean by area, times the target cell's area for the source cell's."""
    factor = (target.size / source.size) ** 2
    return warp(cells, source, target, project, "area_weighted_mean", bends).withColumn("value", F.col("value") * factor)


def nearest(cells: DataFrame, source: Frame, targets: DataFrame, target: Frame, back: Projection) -> DataFrame:
    """row, col, value: each of targets (row, col) takes the source cell that holds its centre. back: from the target's
    coordinates to the source's. An equi join on the cell."""
    x, y = back(F.lit(target.left) + (F.col("row_col.col") + 0.5) * target.size, F.lit(target.top) - (F.col("row_col.row") + 0.5) * target.size)
    placed = targets.select(F.struct("row", "col").alias("row_col"))
    placed = placed.select("row_col", F.floor((x - source.left) / source.size).cast("long").alias("col"), F.floor((source.top - y) / source.size).cast("long").alias("row"))
    return placed.join(cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value"), ["row", "col"]).select("row_col.row", "row_col.col", "value")


def window(target: Frame, source: Frame, back: Projection, points: int = 21, halo: int = 1) -> tuple[Column, Column, Column, Column]:
    """row_start, row_stop, col_start, col_stop of the source cells that a target needs, as columns: the bounds of its outline
    with so many points a side, widened by halo and held within the source."""
    xs, ys = [], []
    for k in range(points):
        t = k / (points - 1)
        for dx, dy in ((t, 0.0), (t, 1.0), (0.0, t), (1.0, t)):
            x, y = back(F.lit(target.left + dx * target.width * target.size), F.lit(target.top - dy * target.height * target.size))
            xs.append((x - source.left) / source.size)
            ys.append((source.top - y) / source.size)
    hold = lambda c, most: F.least(F.greatest(c, F.lit(0)), F.lit(most)).cast("long")
    return (
        hold(F.floor(F.least(*ys)) - halo, source.height).alias("row_start"),
        hold(F.ceil(F.greatest(*ys)) + halo, source.height).alias("row_stop"),
        hold(F.floor(F.least(*xs)) - halo, source.width).alias("col_start"),
        hold(F.ceil(F.greatest(*xs)) + halo, source.width).alias("col_stop"),
    )
