"""Planning grids: tiles, cell ids, eligibility, prefix offsets and dense indexes.

A layer is a DataFrame of (row, col, value); missing cells are NULL or absent. Scans turn NaN and infinities into NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.functions.shared import save

#: Cell sizes in metres of the levels of a grid family.
LEVELS = (30, 60, 120, 240, 480, 960, 1920)


@dataclass(frozen=True)
class Grid:
    """A north-up grid: origin of the upper left corner, cell size, height and width in cells, offsets in the family."""

    x: float
    y: float
    resolution: float
    height: int
    width: int
    row_offset: int = 0
    col_offset: int = 0

    @property
    def area(self) -> float:
        return abs(self.height * self.width * self.resolution**2)


def level(resolution: int) -> int:
    if resolution not in LEVELS:
        raise ValueError(f"no level has cells of {resolution} m")
    return LEVELS.index(resolution)


def build_grid(bounds: Sequence[float], extent: Sequence[float], resolution: float) -> Grid:
    """The grid of whole cells that covers bounds (x0, y0, x1, y1), snapped to the extent's origin and clamped to it."""
    x0, y0, x1, y1 = extent
    c0, c1 = max(0, floor((bounds[0] - x0) / resolution)), min(ceil((x1 - x0) / resolution), ceil((bounds[2] - x0) / resolution))
    r0, r1 = max(0, floor((y1 - bounds[3]) / resolution)), min(ceil((y1 - y0) / resolution), ceil((y1 - bounds[1]) / resolution))
    if c1 <= c0 or r1 <= r0:
        raise ValueError("the bounds lie outside the extent")
    return Grid(x0 + c0 * resolution, y1 - r0 * resolution, resolution, r1 - r0, c1 - c0, r0, c0)


def finite(value: Column) -> Column:
    """NaN and infinities become NULL, once, at the scan."""
    value = value.cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def cell_id(row: Column, col: Column, width: int, height: int | None = None) -> Column:
    """row * width + col; cells outside the grid raise."""
    inside = (row >= 0) & (col >= 0) & (col < width)
    if height is not None:
        inside = inside & (row < height)
    return F.when(inside, row.cast("long") * width + col).otherwise(F.raise_error(F.lit("cell outside the grid")).cast("long"))


def centre(row: Column, col: Column, grid: Grid) -> tuple[Column, Column]:
    return grid.x + (col + 0.5) * grid.resolution, grid.y - (row + 0.5) * grid.resolution


def tiles(spark: SparkSession, grid: Grid, size: int) -> DataFrame:
    """tile_id and bounds of all tiles in row-major order; the last ones may be ragged."""
    rows = spark.range(0, grid.height, size).select(F.col("id").alias("row_start"), F.explode(F.sequence(F.lit(0), F.lit(grid.width - 1), F.lit(size)).cast("array<long>")).alias("col_start"))
    stop = lambda start, top: F.least(F.col(start) + size, F.lit(top))
    return rows.select(
        F.format_string("r%09d-c%09d", "row_start", "col_start").alias("tile_id"), "row_start", stop("row_start", grid.height).alias("row_stop"), "col_start", stop("col_start", grid.width).alias("col_stop")
    )


def in_tiles(cells: DataFrame, size: int) -> DataFrame:
    return cells.withColumns({"tile_r": F.floor(F.col("row") / size), "tile_c": F.floor(F.col("col") / size)})


def padded(cells: DataFrame, spark: SparkSession, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """The window [rows) x [cols) of a layer; cells that it lacks, also outside, have a NULL value."""
    window = spark.range(*rows).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(cols[0]), F.lit(cols[1] - 1)).cast("array<long>")).alias("col")).where(F.col("col").between(cols[0], cols[1] - 1))
    near = cells.where(F.col("row").between(rows[0], rows[1] - 1) & F.col("col").between(cols[0], cols[1] - 1))
    return window.join(near.select("row", "col", "value"), ["row", "col"], "left")


def eligible(cells: DataFrame, required: Sequence[str] = (), bounds: dict[str, tuple[float | None, float | None]] | None = None) -> Column:
    """Required layers present, and bounded layers present and within their inclusive bounds."""
    ok = F.lit(True)
    for name in required:
        ok = ok & F.col(name).isNotNull()
    for name, (low, high) in (bounds or {}).items():
        ok = ok & F.col(name).isNotNull()
        ok = ok if low is None else ok & (F.col(name) >= low)
        ok = ok if high is None else ok & (F.col(name) <= high)
    return F.coalesce(ok, F.lit(False))


def telemetry(cells: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """For each predicate in turn: units before and after it. One pass."""
    so_far, aggregates = F.lit(True), [F.count("*").alias("n0")]
    for k, p in enumerate(predicates.values()):
        so_far = so_far & F.coalesce(p, F.lit(False))
        aggregates.append(F.count_if(so_far).alias(f"n{k + 1}"))
    rows = [F.struct(F.lit(k).alias("step"), F.lit(name).alias("predicate"), F.col(f"n{k}").alias("units_in"), F.col(f"n{k + 1}").alias("units_out")) for k, name in enumerate(predicates)]
    return cells.agg(*aggregates).select(F.inline(F.array(*rows)))


def tile_counts(cells: DataFrame, ok: Column) -> DataFrame:
    """Per tile: cells, eligible cells, their share, and the exclusive prefix sum in row-major order of the tiles.

    The prefix sum is over one row per tile, which is small whatever the number of cells.
    """
    rows = cells.groupBy("tile_r", "tile_c").agg(F.count("*").alias("cells"), F.count_if(ok).alias("units"))
    before = Window.orderBy("tile_r", "tile_c").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({"valid_fraction": F.col("units") / F.col("cells"), "index_offset": F.coalesce(F.sum("units").over(before), F.lit(0)).cast("long")})


def dense_index(cells: DataFrame, ok: Column) -> DataFrame:
    """The eligible cells with a dense variable_index: tile by tile, row-major within a tile."""
    offsets = tile_counts(cells, ok).select("tile_r", "tile_c", "index_offset")
    rank = F.row_number().over(Window.partitionBy("tile_r", "tile_c").orderBy("row", "col"))
    return cells.where(ok).withColumn("rank", rank).join(offsets, ["tile_r", "tile_c"]).withColumn("variable_index", F.col("index_offset") + F.col("rank") - 1).drop("rank", "index_offset")


def sparse(features: DataFrame) -> DataFrame:
    """feature_index, variable_index, amount: only finite amounts other than nought."""
    return features.withColumn("amount", finite(F.col("amount"))).where(F.col("amount").isNotNull() & (F.col("amount") != 0))


def ranged(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """df sorted by order into ranges, numbered by p, as a table of its own: ranges are as many as shuffle partitions, ties
    in a key are split by what follows it, and the numbers stay the same however often the table is read."""
    return save(df.repartitionByRange(*order).withColumn("p", F.spark_partition_id()))


def running_sum(df: DataFrame, key: str, descending: bool, tie: str, value: str, name: str) -> DataFrame:
    """Inclusive running sum over the whole table without one task for it: the sums of the ranges give each its start.

    Rows are added in order of (key, tie); rows without a key come last if descending, else first.
    """
    order = [F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_first(), F.col(tie).asc()]
    rows = ranged(df, order)
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("p").agg(F.sum(value).alias("t")).withColumn("start", F.coalesce(F.sum("t").over(before), F.lit(0))).select("p", "start")
    inner = F.sum(value).over(Window.partitionBy("p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("inner", inner).join(F.broadcast(starts), "p").withColumn(name, F.col("start") + F.col("inner")).drop("p", "start", "inner")


def ranked(df: DataFrame, key: str, tie: str, name: str = "rank") -> DataFrame:
    """Rank from 1 by key descending, then tie, over the whole table."""
    return running_sum(df.withColumn("one", F.lit(1).cast("long")), key, True, tie, "one", name).drop("one")


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number from 0 in the given order over the whole table; one row a range is all that meets."""
    rows = ranged(df, order)
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("p").agg(F.count("*").alias("t")).withColumn("start", F.coalesce(F.sum("t").over(before), F.lit(0))).select("p", "start")
    return rows.withColumn("inner", F.row_number().over(Window.partitionBy("p").orderBy(*order))).join(F.broadcast(starts), "p").withColumn(name, F.col("start") + F.col("inner") - 1).drop("p", "start", "inner")


def ranks_within(df: DataFrame, group: str, order: Sequence[Column], name: str) -> DataFrame:
    """Rank from 1 within each group, also of groups that hold most rows: a group spans ranges, whose counts give each its start."""
    rows = ranged(df, [F.col(group), *order])
    before = Window.partitionBy(group).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(group, "p").agg(F.count("*").alias("t")).withColumn("start", F.coalesce(F.sum("t").over(before), F.lit(0))).drop("t")
    inner = F.row_number().over(Window.partitionBy(group, "p").orderBy(*order))
    return rows.withColumn("inner", inner).join(starts, [group, "p"]).withColumn(name, F.col("start") + F.col("inner")).drop("p", "start", "inner")
