"""Selections under resource rows without a solver of whole numbers: starting points, and what the best loses by a unit.

A resource row has an upper bound and no negative coefficient.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.shared import save
from terrane.operators import linear
from terrane.operators.grid import ranged


def running_sums(df: DataFrame, order: Sequence[Column], names: Sequence[str]) -> DataFrame:
    """df with sum_<name>, inclusive over the whole table in this order; what order leaves equal must be equal rows. Ranges are
    summed side by side; a row for each is all that meets."""
    rows = ranged(df, order)
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("p").agg(*(F.sum(n).alias(f"t_{n}") for n in names))
    starts = totals.select("p", *(F.coalesce(F.sum(f"t_{n}").over(before), F.lit(0.0)).alias(f"s_{n}") for n in names))
    inner = Window.partitionBy("p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("*", *(F.sum(n).over(inner).alias(f"i_{n}") for n in names)).join(F.broadcast(starts), "p")
    return out.select(*df.columns, *((F.col(f"s_{n}") + F.col(f"i_{n}")).alias(f"sum_{n}") for n in names))


def as_of(points: DataFrame, probes: DataFrame, at: str, order: Sequence[str]) -> DataFrame:
    """probes with what: the columns of the last of points (in the order of at, then order) that isn't after the probe.

    Both are sorted into ranges together; the last point of each range is handed on to the next ones, so neither side is
    sent whole to a task however the values lie.
    """
    what = F.struct(*points.columns)
    kinds = {f.name: f.dataType for f in probes.schema.fields}
    left = points.select(F.col(at).alias("at_"), F.lit(0).alias("kind_"), F.struct(*order).alias("order_"), what.alias("what"), *(F.lit(None).cast(t).alias(f"p_{c}") for c, t in kinds.items()))
    nothing = [F.lit(None).cast(t).alias(f.name) for f, t in ((points.schema[c], points.schema[c].dataType) for c in order)]
    right = probes.select(F.col(at).alias("at_"), F.lit(1).alias("kind_"), F.struct(*nothing).alias("order_"), F.lit(None).cast(left.schema["what"].dataType).alias("what"), *(F.col(c).alias(f"p_{c}") for c in kinds))
    keys = [F.asc("at_"), F.asc("kind_"), F.asc("order_"), *(F.asc(f"p_{c}") for c in kinds)]
    rows = ranged(left.unionByName(right), keys)
    place = F.struct("at_", "order_")
    ends = rows.where("kind_ = 0").groupBy("p").agg(F.max_by("what", place).alias("last"))
    every = rows.select("p").distinct().join(ends, "p", "left")
    carried = every.select("p", F.last("last", True).over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    here = F.last("what", True).over(Window.partitionBy("p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("here", here).where("kind_ = 1").join(F.broadcast(carried), "p")
    return out.select(*(F.col(f"p_{c}").alias(c) for c in kinds), F.coalesce("here", "carried").alias("what"))


def exclusions(units: DataFrame, budget: float) -> DataFrame:
    """unit, x, loss: the best allocation between 0 and 1 under one resource row, and what it loses without each unit.

    units: unit, objective, cost. The best is a prefix in order of density. Without a unit of the prefix all that follows
    moves up by its cost, so its loss is read off the same running sums at budget + cost: all units cost one sort, not one
    solution each. Units without a positive objective are never taken. Costs aren't negative; NULL counts as nought.
    """
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    units = units.select("unit", value("objective"), value("cost"))
    density = F.when(F.col("cost") > 0, F.col("objective") / F.col("cost")).otherwise(F.lit(float("inf")))
    rows = running_sums(units.where("objective > 0").withColumn("density", density), [F.desc("density"), F.asc("unit")], ["cost", "objective"])
    rows = save(rows.select("unit", "objective", "cost", "density", (F.col("sum_cost") - F.col("cost")).alias("start"), (F.col("sum_objective") - F.col("objective")).alias("before")))
    b = F.lit(float(budget))
    taken = rows.where((F.col("start") < b) | (F.col("cost") == 0) & (F.col("start") <= b))
    probes = taken.select("unit", (b + F.col("cost")).alias("start"))
    kind = probes.schema["unit"].dataType
    probes = probes.unionByName(rows.sparkSession.range(1).select(F.lit(None).cast(kind).alias("unit"), b.alias("start")))
    points = rows.select("start", F.col("density").alias("by"), "before", "objective", "cost", "unit")
    # the order of equal starts is that of the units: densest first
    found = as_of(points.withColumn("by", -F.col("by")), probes, "start", ["by", "unit"])
    part = F.least(F.lit(1.0), (F.col("start") - F.col("what.start")) / F.col("what.cost"))
    worth = F.coalesce(F.col("what.before") + F.col("what.objective") * F.when(F.col("what.cost") > 0, part).otherwise(1.0), F.lit(0.0))
    found = save(found.select("unit", worth.alias("worth")))
    best = found.where("unit IS NULL").first().worth if float(budget) >= 0 else 0.0
    share = F.when(F.col("cost") > 0, F.least(F.lit(1.0), (b - F.col("start")) / F.col("cost"))).otherwise(1.0)
    out = taken.join(found, "unit").select("unit", share.alias("x"), F.greatest(F.lit(best) - (F.col("worth") - F.col("objective")), F.lit(0.0)).alias("loss"))
    return units.select("unit").join(out, "unit", "left").fillna(0.0, ["x", "loss"])


def _broken(p: linear.Program, x: DataFrame) -> float:
    """By how much the rows are broken at most, in their own measure."""
    sums = p.columns.join(x.hint("merge"), "unit").select("x", F.explode(F.arrays_zip("at", "coefs")).alias("e")).groupBy("e.at").agg(F.sum(F.col("x") * F.col("e.coefs")).alias("s"))
    activity = np.zeros(len(p.names))
    for r in sums.collect():  # at most linear.ROWS
        activity[r["at"]] = r.s
    return float(np.maximum(np.maximum(p.low * p.scale - activity, activity - p.high * p.scale), 0).max(initial=0.0))


def _filled(p: linear.Program, base: DataFrame, key: Column, resources: list[int], passes: int = 4) -> DataFrame:
    """unit, x: base and then, by key, all units up to the first that some resource has no room for; what still fits beside
    them is tried again."""
    chosen = save(base)
    wide = F.map_from_arrays("at", "coefs")
    names = [f"a{i}" for i in resources]
    cost = lambda i: F.coalesce(wide[F.lit(i)], F.lit(0.0))
    table = save(p.columns.withColumn("key", key).select("unit", "objective", "high", "low", "key", *((cost(i) * (F.col("high") - F.col("low"))).alias(f"a{i}") for i in resources)))
    for _ in range(passes):
        state = table.join(chosen.hint("merge"), "unit")
        used = p.columns.join(chosen.hint("merge"), "unit").select("x", F.explode(F.arrays_zip("at", "coefs")).alias("e")).groupBy("e.at").agg(F.sum(F.col("x") * F.col("e.coefs")).alias("s")).collect()
        room = {i: float(p.high[i] * p.scale[i]) for i in resources}
        for r in used:
            if r["at"] in room:
                room[r["at"]] -= r.s
        open_ones = state.where((F.col("x") < F.col("high")) & (F.col("objective") > 0))
        for i in resources:
            open_ones = open_ones.where(F.col(f"a{i}") <= room[i] + 1e-9)
        rows = running_sums(open_ones.drop("x"), [F.desc("key"), F.asc("unit")], names) if names else open_ones.drop("x")
        for i in resources:
            rows = rows.where(F.col(f"sum_a{i}") <= room[i] + 1e-9)
        new = save(rows.select("unit", F.col("high").alias("new")))
        if new.isEmpty():
            break
        chosen = save(chosen.join(new.hint("merge"), "unit", "left").select("unit", F.coalesce("new", "x").alias("x")))
    return chosen


def warm_start(units: DataFrame, rows: DataFrame, nonzeros: DataFrame) -> DataFrame | None:
    """unit, x: a selection that keeps all rows, to start a search from; None if none was found.

    All units of positive objective, if the rows let them. Else the resource rows are filled in order of value for the
    shares of the resources that a unit takes (with one row: by density), and in order of what the prices of the
    continuous program leave of the value; the latter also on top of the units that program takes whole. The best one
    that keeps all rows is returned, so never less than filling by density; without any, what units are bound to.
    units, rows, nonzeros: as in linear.program().
    """
    p = linear.program(units, rows, nonzeros)
    lowest = p.columns.select("unit", F.col("low").alias("x"))
    all_of_them = p.columns.select("unit", F.when(F.col("objective") > 0, F.col("high")).otherwise(F.col("low")).alias("x"))
    if _broken(p, all_of_them) <= 1e-9:
        return all_of_them
    negative = {r["at"] for r in p.columns.select(F.explode(F.arrays_zip("at", "coefs")).alias("e")).groupBy("e.at").agg(F.min("e.coefs").alias("m")).where("m < 0").collect()}
    resources = [i for i in range(len(p.names)) if np.isfinite(p.high[i]) and i not in negative]
    wide, room = F.map_from_arrays("at", "coefs"), {i: max(float(p.high[i] * p.scale[i]), 1e-12) for i in resources}
    share = sum((F.coalesce(wide[F.lit(i)], F.lit(0.0)) / room[i] for i in resources), F.lit(0.0))
    found = [_filled(p, lowest, F.when(share > 0, F.col("objective") / share).otherwise(F.lit(1e300)), resources)]
    best = linear.solve(p)[0]
    if best.status == "infeasible":
        return None
    if best.prices is not None:
        priced = F.col("objective") - sum((F.coalesce(wide[F.lit(i)], F.lit(0.0)) * float(best.prices[i]) for i in range(len(p.names))), F.lit(0.0))
        whole = linear.allocations(p, best).select("unit", F.when(F.col("x") >= F.col("high") - 1e-6, F.col("high")).otherwise(F.col("low")).alias("x"))
        found += [_filled(p, base, priced, resources) for base in (lowest, whole)]
    worth = lambda x: x.join(p.columns.hint("merge"), "unit").agg(F.coalesce(F.sum(F.col("x") * F.col("objective")), F.lit(0.0))).first()[0]
    kept = [x for x in [*found, save(lowest)] if _broken(p, x) <= 1e-6]
    return max(kept, key=worth) if kept else None
