"""Objectives, linear rows, checks of solutions, and the exact selections that need no solver.

A model is three tables: variables, rows (row_id, low, high) and nonzeros (row_id, unit, coef).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.grid import ranked, ranks_within, running_sum


#: The largest k up to which every task keeps only the k best of its rows before the shuffle.
SMALL = 1000


def top_k_scale(values: DataFrame, k: int) -> DataFrame:
    """layer, scale: the sum of a layer's k largest positive amounts, of any k."""
    rows, order = values.where("amount > 0 AND NOT isnan(amount)"), [F.desc("amount"), F.asc("unit")]
    if k <= SMALL:
        rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("layer").orderBy(*order)))
    else:
        rows = ranks_within(rows, "layer", order, "k")
    return rows.where(F.col("k") <= k).groupBy("layer").agg(F.sum("amount").alias("scale"))


def normalised(scales: DataFrame) -> DataFrame:
    """coefficient = +-importance / scale by direction; without a scale 0 and degenerate."""
    sign = F.when(F.col("direction") == "minimize", -1.0).otherwise(1.0)
    some = F.coalesce(F.col("scale"), F.lit(0.0)) > 0
    return scales.withColumns({"coefficient": F.when(some, sign * F.col("importance") / F.col("scale")).otherwise(0.0), "degenerate": ~some})


def fused(values: DataFrame, objectives: DataFrame) -> DataFrame:
    """unit, objective: the weighted sum of a unit's layers. objectives has a row per layer of the problem."""
    return values.join(F.broadcast(objectives.select("layer", "coefficient")), "layer").groupBy("unit").agg(F.sum(F.col("coefficient") * F.col("amount")).alias("objective"))


def activity(nonzeros: DataFrame, x: DataFrame) -> DataFrame:
    return nonzeros.join(x, "unit").groupBy("row_id").agg(F.sum(F.col("coef") * F.col("x")).alias("activity"))


def possible(nonzeros: DataFrame) -> DataFrame:
    """Least and greatest activity of each row for x between 0 and 1."""
    c = F.col("coef")
    return nonzeros.groupBy("row_id").agg(F.coalesce(F.sum(F.when(c < 0, c)), F.lit(0.0)).alias("least"), F.coalesce(F.sum(F.when(c > 0, c)), F.lit(0.0)).alias("greatest"))


def fold_fixed(nonzeros: DataFrame, states: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with their bounds less what units that are fixed in contribute."""
    fixed = nonzeros.join(states.where("state = 1"), "unit").groupBy("row_id").agg(F.sum("coef").alias("fixed"))
    fixed_part = F.coalesce("fixed", F.lit(0.0))
    return rows.join(fixed, "row_id", "left").select("row_id", (F.col("low") - fixed_part).alias("low"), (F.col("high") - fixed_part).alias("high"))


def bound_violation(value: str, low: Column, high: Column) -> Column:
    return F.max(F.greatest(low - F.col(value), F.col(value) - high, F.lit(0.0)))


def integrality_violation(x: str) -> Column:
    return F.max(F.abs(F.col(x) - F.rint(F.col(x))))


def greedy(units: DataFrame, budget: float) -> DataFrame:
    """Units by value for cost (no cost first, then id) while the running cost fits the budget. Costs aren't negative."""
    density = F.when(F.col("cost") > 0, F.col("objective") / F.col("cost")).otherwise(F.lit(1e300))
    rows = running_sum(units.where("objective > 0").withColumn("density", density), "density", True, "unit", "cost", "spent")
    return rows.where(F.col("spent") <= budget + 1e-9).drop("density")


def fractional(units: DataFrame, budget: float) -> DataFrame:
    """Optimum with allocations between 0 and 1 under one cost row: by density, the last unit in part. Costs are positive."""
    rows = units.where("objective > 0").withColumn("density", F.col("objective") / F.col("cost"))
    rows = running_sum(rows, "density", True, "unit", "cost", "spent").drop("density")
    x = F.least(F.lit(1.0), (budget - (F.col("spent") - F.col("cost"))) / F.col("cost"))
    return rows.withColumn("x", x).where("x > 0")


def threshold(units: DataFrame) -> DataFrame:
    """Optimum without rows: what has a positive objective."""
    return units.withColumn("x", (F.col("objective") > 1e-12).cast("double"))


def priority(units: DataFrame, shares: list[float]) -> DataFrame:
    """unit, priority: the mean allocation over nested budgets (shares of the number of units)."""
    rows = ranked(units, "objective", "unit")  # a table by now, so the units are not made anew to count them
    n = rows.agg(F.coalesce(F.max("rank"), F.lit(0))).first()[0]
    allocation = lambda b: F.least(F.greatest(F.lit(b * n) - (F.col("rank") - 1), F.lit(0.0)), F.lit(1.0))
    return rows.select("unit", "rank", (sum((allocation(b) for b in shares), F.lit(0.0)) / len(shares)).alias("priority"))


def nested(allocations: DataFrame) -> DataFrame:
    """unit, budget of allocations (unit, budget, x) that fall where the budget grows."""
    before = F.lag("x").over(Window.partitionBy("unit").orderBy("budget"))
    return allocations.withColumn("before", before).where("x < before - 1e-9").select("unit", "budget")


def irreplaceability(units: DataFrame, k: int) -> DataFrame:
    """unit, loss: what the best k units lose if one of them may not be chosen; 0 for the rest."""
    rows = ranked(units, "objective", "unit")
    spare = rows.where(F.col("rank") == k + 1).agg(F.coalesce(F.greatest(F.max("objective"), F.lit(0.0)), F.lit(0.0)).alias("spare"))
    chosen = (F.col("rank") <= k) & (F.col("objective") > 0)
    return rows.crossJoin(F.broadcast(spare)).select("unit", F.when(chosen, F.col("objective") - F.col("spare")).otherwise(0.0).alias("loss"))
