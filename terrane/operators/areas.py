"""Many areas over many cells: which points lie in which areas, by an index of the bins that areas cover.

areas: area_id and area, an array of polygons (arrays of rings of x, y; the first ring less the others). Every polygon is
cut into strips of bins, and a bin keeps only those edges that a ray to the right from within it can meet; a bin that no
edge comes near is inside or outside as a whole. Points join the bins they stand in, so a point is compared with the few
areas around it, and with few of their edges. Results are those of geo.in_area, also on edges and corners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(value: Column | str, step: float) -> Column:
    return F.floor((F.col(value) if isinstance(value, str) else value) / F.lit(float(step))).cast("long")


def _crossings(edges: Column, x: Column, y: Column) -> Column:
    """Whether a ray to the right from (x, y) crosses an odd number of edges."""
    crossed = lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"])
    return F.size(F.filter(edges, lambda e: F.coalesce(crossed(e), F.lit(False)))) % 2 == 1


def _inside(edges: Column, x: Column, y: Column) -> Column:
    """In the first ring and in no other."""
    first = _crossings(F.filter(edges, lambda e: e["ring"] == 0), x, y)
    holes = F.array_distinct(F.transform(F.filter(edges, lambda e: e["ring"] > 0), lambda e: e["ring"]))
    return first & ~F.exists(holes, lambda k: _crossings(F.filter(edges, lambda e: e["ring"] == k), x, y))


def cover(areas: DataFrame, step: float) -> DataFrame:
    """area_id, polygon, bin_x, bin_y, edges (NULL: the whole bin is inside) of the bins of side step that areas reach into."""
    rings = areas.select("area_id", F.posexplode("area").alias("polygon", "rings")).select("area_id", "polygon", F.posexplode("rings").alias("ring", "points"))
    following = F.concat(F.slice("points", F.lit(2), F.greatest(F.size("points") - 1, F.lit(0))), F.slice("points", 1, 1))
    ends = F.zip_with("points", following, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    edges = rings.where(F.size("points") > 0).select("area_id", "polygon", "ring", F.inline(ends)).where("ax IS NOT NULL AND ay IS NOT NULL AND bx IS NOT NULL AND by IS NOT NULL")
    strips = edges.withColumn("bin_y", F.explode(F.sequence(_bin(F.least("ay", "by"), step), _bin(F.greatest("ay", "by"), step))))
    strips = strips.groupBy("area_id", "polygon", "bin_y").agg(F.collect_list(F.struct("ring", "ax", "ay", "bx", "by")).alias("edges"), F.min(_bin(F.least("ax", "bx"), step)).alias("from_x"), F.max(_bin(F.greatest("ax", "bx"), step)).alias("to_x"))
    bins = strips.withColumn("bin_x", F.explode(F.sequence("from_x", "to_x")))
    near = F.exists("edges", lambda e: (_bin(F.least(e["ax"], e["bx"]), step) <= F.col("bin_x")) & (_bin(F.greatest(e["ax"], e["bx"]), step) >= F.col("bin_x")))
    middle = lambda c: (F.col(c) + 0.5) * step
    met = F.filter("edges", lambda e: _bin(F.greatest(e["ax"], e["bx"]), step) >= F.col("bin_x"))
    bins = bins.select("area_id", "polygon", "bin_x", "bin_y", near.alias("near"), met.alias("edges"))
    bins = bins.where(F.col("near") | _inside(F.col("edges"), middle("bin_x"), middle("bin_y")))
    return bins.select("area_id", "polygon", "bin_x", "bin_y", F.when(F.col("near"), F.col("edges")).alias("edges"))


def within(points: DataFrame, areas: DataFrame, step: float, key: str) -> DataFrame:
    """key, area_id: each point (key, x, y) with every area it lies in, once. Points without a place lie in none.

    step: the side of a bin, some times that of a cell; it changes the work, not the result.
    """
    placed = points.where("x IS NOT NULL AND y IS NOT NULL").select(F.col(key), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    placed = placed.withColumns({"bin_x": _bin("x", step), "bin_y": _bin("y", step)})
    found = placed.join(cover(areas, step), ["bin_x", "bin_y"]).where(F.col("edges").isNull() | _inside(F.col("edges"), F.col("x"), F.col("y")))
    return found.groupBy(key, "area_id").agg(F.count("*").alias("n")).select(key, "area_id")


def summary(points: DataFrame, areas: DataFrame, step: float, key: str) -> DataFrame:
    """area_id, cells, x0, y0, x1, y1 of the points in each area; areas without any have no row."""
    rows = within(points, areas, step, key).join(points.select(key, "x", "y"), key)
    return rows.groupBy("area_id").agg(F.count("*").alias("cells"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
