import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from terrane.functions import geo
from terrane.operators import areas, warp

AREA = "area_id long, area array<array<array<struct<x: double, y: double>>>>"


def star(r, x, y, size, points):
    """A ring around a point that is not convex."""
    at = sorted(r.random() * 2 * math.pi for _ in range(points))
    return [(x + size * r.uniform(0.3, 1) * math.cos(a), y + size * r.uniform(0.3, 1) * math.sin(a)) for a in at]


@pytest.mark.parametrize("step", [0.7, 3.0, 50.0])
def test_points_in_areas_as_in_area(spark, step):
    r = random.Random(9)
    shapes = [(k, [[star(r, r.uniform(0, 40), r.uniform(-20, 20), r.uniform(0.5, 12), r.randrange(3, 12))] for _ in range(r.randrange(1, 4))]) for k in range(25)]
    square = lambda a, b: [(float(x), float(y)) for x, y in ((a, a), (b, a), (b, b), (a, b), (a, a))]
    shapes += [(50, [[square(0, 10), square(3, 6), square(7, 8)]]), (51, [[square(0, 5)], [square(4, 9)]]), (52, []), (53, [[[]]]), (54, [[[(1.0, 1.0)]]]), (55, [[[(-4.0, 0.0), (30.0, 0.25), (30.0, 0.0)]]])]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate([(x / 2, y / 2) for x in range(-4, 84) for y in range(-44, 44)])] + [(-1, None, 1.0), (-2, 3.0, None)]
    frame = spark.createDataFrame(shapes, AREA)
    cells = spark.createDataFrame(points, "cell long, x double, y double")
    got = sorted(map(tuple, areas.within(cells, frame, step, "cell").collect()))
    want = cells.where("x IS NOT NULL AND y IS NOT NULL").crossJoin(frame).where(F.coalesce(geo.in_area(F.col("x"), F.col("y"), F.col("area")), F.lit(False)))
    assert got == sorted(map(tuple, want.select("cell", "area_id").collect())) and len(got) > 1000


def test_index_of_a_large_area_keeps_few_edges(spark):
    ring = [(1000 + 900 * math.cos(k / 500 * math.pi), 1000 + 900 * math.sin(k / 500 * math.pi)) for k in range(1000)]
    index = areas.cover(spark.createDataFrame([(1, [[ring]])], AREA), 50.0)
    whole, n, edges = index.agg(F.count_if(F.col("edges").isNull()), F.count("*"), F.max(F.size("edges"))).first()
    assert whole > 0.7 * n and edges < 120
    assert areas.within(spark.createDataFrame([], "cell long, x double, y double"), spark.createDataFrame([], AREA), 5.0, "cell").count() == 0


def clipped(polygon, c, r):
    """Area of a polygon in the unit cell, by cutting it side by side."""
    for axis, at, sign in ((0, c, 1), (0, c + 1, -1), (1, r, 1), (1, r + 1, -1)):
        out = []
        for a, b in zip(polygon, polygon[1:] + polygon[:1]):
            da, db = sign * (a[axis] - at), sign * (b[axis] - at)
            if da >= 0:
                out.append(a)
            if da * db < 0:
                t = da / (da - db)
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        polygon = out
        if not polygon:
            return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(polygon, polygon[1:] + polygon[:1]))) / 2


def turned(x, y):
    """A projection that turns, stretches and bends."""
    return 0.9 * x + 0.3 * y + 0.002 * x * x, 0.8 * y - 0.25 * x + 0.001 * x * y


def test_warp_as_cut_cell_by_cell(spark):
    r = np.random.default_rng(4)
    source, target = warp.Frame(0.0, 50.0, 1.0, 50, 50), warp.Frame(5.0, 45.0, 2.5, 17, 18)
    values = {(i, j): float(r.integers(0, 5)) for i in range(50) for j in range(50) if r.random() > 0.1}
    parts = {}
    for (i, j), v in values.items():
        polygon = [((x - 5.0) / 2.5, (45.0 - y) / 2.5) for x, y in (turned(j + a, 50.0 - i - b) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1)))]
        whole = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(polygon, polygon[1:] + polygon[:1]))) / 2
        for c in range(max(0, math.floor(min(p[0] for p in polygon))), min(18, math.ceil(max(p[0] for p in polygon)))):
            for q in range(max(0, math.floor(min(p[1] for p in polygon))), min(17, math.ceil(max(p[1] for p in polygon)))):
                if (w := clipped(polygon, c, q)) > 1e-9:
                    parts.setdefault((q, c), []).append((v, w, whole))

    def by_value(p):
        out = {}
        for v, w, _ in p:
            out[v] = out.get(v, 0) + w
        return out

    def median(p):
        total, upto = sum(w for _, w, _ in p) / 2, 0
        for v, w in sorted(by_value(p).items()):
            upto += w
            if upto >= total - 1e-9:
                return v

    want = {
        "sum": lambda p: sum(v * w / a for v, w, a in p), "area_weighted_mean": lambda p: sum(v * w for v, w, _ in p) / sum(w for _, w, _ in p), "maximum": lambda p: max(v for v, _, _ in p), "minimum": lambda p: min(v for v, _, _ in p),
        "mode": lambda p: max(by_value(p).items(), key=lambda x: (round(x[1], 9), -x[0]))[0], "median": median,
    }
    cells = spark.createDataFrame([(i, j, v) for (i, j), v in values.items()] + [(0, 0, None), (0, 1, float("nan"))], "row long, col long, value double")
    for statistic, f in want.items():
        got = {(x.row, x.col): x.value for x in warp.warp(cells, source, target, turned, statistic).collect()}
        assert set(got) == set(parts)
        assert all(got[k] == pytest.approx(f(p), abs=1e-6) for k, p in parts.items()), statistic
    with pytest.raises(ValueError):
        warp.warp(cells, source, target, turned, "range")


def test_bent_edges_and_amounts(spark):
    cells = spark.createDataFrame([(0, 0, 8.0)], "row long, col long, value double")
    coarse, fine = warp.Frame(0.0, 2.0, 2.0, 1, 1), warp.Frame(0.0, 2.0, 1.0, 2, 2)
    assert [x.value for x in warp.extensive(cells, coarse, fine, lambda x, y: (x, y)).collect()] == [2.0] * 4
    bent = lambda x, y: (x, y + 0.1 * x * x)  # noqa: E731  area stays, straight corners would lose none of it
    area = warp.shares(cells, coarse, warp.Frame(-1.0, 4.0, 0.25, 40, 40), bent, 16).agg(F.sum("area")).first()[0]
    assert area == pytest.approx(4.0 / 0.0625, rel=1e-9)


def test_albers_there_and_back(spark):
    places = [(-126.0, 45.0), (-123.1, 49.25), (-139.0, 60.0), (-114.0, 49.0)]
    p = geo.Albers()
    frame = spark.createDataFrame(places, "lon double, lat double")
    x, y = p.forward(F.col("lon"), F.col("lat"))
    rows = frame.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = p.inverse(F.col("x"), F.col("y"))
    for r in rows.withColumns({"lon2": lon, "lat2": lat}).collect():
        assert (r.lon2, r.lat2) == pytest.approx((r.lon, r.lat), abs=1e-8)
    first = rows.collect()[0]
    assert (first.x, first.y) == pytest.approx((1_000_000.0, 0.0), abs=1e-6)
    # scale along the meridian and across it multiply to one: the projection keeps areas
    d = 1e-4
    x, y = zip(*(p.forward(F.lit(-123.0 + a * d), F.lit(52.0 + b * d)) for a, b in ((0, 0), (1, 0), (0, 1))))
    v = spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate([*x, *y]))).first()
    plane = abs((v.c1 - v.c0) * (v.c5 - v.c3) - (v.c2 - v.c0) * (v.c4 - v.c3))
    e2, a = p.e2, p.a
    s = math.sin(math.radians(52.0))
    ground = a * a * (1 - e2) * math.cos(math.radians(52.0)) / (1 - e2 * s * s) ** 2 * math.radians(d) ** 2
    assert plane == pytest.approx(ground, rel=1e-5)
    lon, lat = geo.web_mercator_inverse(*geo.web_mercator(F.lit(-123.0), F.lit(49.0)))
    assert tuple(spark.range(1).select(lon, lat).first()) == pytest.approx((-123.0, 49.0), abs=1e-9)


def test_nearest_and_window(spark):
    cells = spark.createDataFrame([(i, j, float(10 * i + j)) for i in range(4) for j in range(4)], "row long, col long, value double")
    source, target = warp.Frame(0.0, 40.0, 10.0, 4, 4), warp.Frame(12.0, 38.0, 4.0, 3, 3)
    grid = spark.createDataFrame([(i, j) for i in range(3) for j in range(3)], "row long, col long")
    got = {(r.row, r.col): r.value for r in warp.nearest(cells, source, grid, target, lambda x, y: (x, y)).collect()}
    assert got == {(i, j): float(10 * math.floor((2 + 4 * i + 2) / 10) + math.floor((12 + 4 * j + 2) / 10)) for i in range(3) for j in range(3)}
    assert tuple(spark.range(1).select(*warp.window(target, source, lambda x, y: (x, y))).first()) == (0, 3, 0, 4)
    assert tuple(spark.range(1).select(*warp.window(target, source, lambda x, y: (x, y), halo=0)).first()) == (0, 2, 1, 3)
