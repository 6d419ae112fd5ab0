"""Layer contracts: which statistics a kind of quantity admits, and how a layer maps onto a grid."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kind of quantity and the statistics it admits.
ADMITTED = {
    "amount": ("sum", "area_weighted_mean", "median", "maximum", "minimum"),
    "density": ("area_weighted_mean", "median", "maximum", "minimum"),
    "probability": ("area_weighted_mean", "median", "maximum", "minimum"),
    "binary": ("any", "fraction", "mode", "maximum", "minimum"),
    "categorical": ("mode",),
    "cost": ("sum", "area_weighted_mean", "median", "maximum", "minimum"),
}
#: What a quantity can be.
QUANTITIES = ("extensive", "intensive", "categorical")


def violations(spark: SparkSession, contracts: DataFrame) -> DataFrame:
    """layer, problem: contracts (layer, kind, statistic, quantity, tie_rule) that break a rule."""
    rules = spark.range(1).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ADMITTED)), F.array(*(F.array(*map(F.lit, v)) for v in ADMITTED.values())))).alias("kind", "admitted"))
    rows = contracts.join(F.broadcast(rules), "kind", "left")
    checks = (
        (F.col("admitted").isNull(), "unknown kind"),
        (F.col("admitted").isNotNull() & ~F.coalesce(F.array_contains("admitted", F.col("statistic")), F.lit(False)), "statistic not admitted"),
        (~F.coalesce(F.col("quantity").isin(*QUANTITIES), F.lit(False)), "unknown quantity"),
        ((F.col("statistic") == "mode") & ~F.col("quantity").eqNullSafe(F.lit("categorical")), "mode needs a categorical quantity"),
        ((F.col("statistic") == "mode") & ~F.col("tie_rule").eqNullSafe(F.lit("lowest_value")), "mode needs the lowest value on ties"),
        ((F.col("statistic") == "sum") & ~F.col("quantity").eqNullSafe(F.lit("extensive")), "sum needs an extensive quantity"),
    )
    problems = F.array_compact(F.array(*(F.when(c, text) for c, text in checks)))
    return rows.select("layer", F.explode(problems).alias("problem"))


def mapping(native: Column, target: Column, offset_x: Column, offset_y: Column, policy: Column, tolerance: float = 1e-7) -> Column:
    """How cells of the native size get onto the target size: direct, nested_aggregate, bounded_reproject, coarse_to_fine_supported or unsupported."""
    ratio = target / native
    whole = lambda c: F.abs(c - F.round(c)) <= tolerance
    aligned = whole(offset_x / native) & whole(offset_y / native)
    return (
        F.when(native > target * (1 + tolerance), F.when(policy.isin("nearest_constant", "overlap_constant"), "coarse_to_fine_supported").otherwise("unsupported"))
        .when(aligned & (F.abs(ratio - 1) <= tolerance), "direct")
        .when(aligned & whole(ratio), "nested_aggregate")
        .otherwise("bounded_reproject")
    )


def canonical_json(value) -> str:
    """Keys sorted at all depths, no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_hash(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def footprints(models: DataFrame, safety: float = 1.5) -> DataFrame:
    """models with compiler_bytes, solver_bytes, scratch_bytes and peak_bytes.

    models: planning_units, primary, auxiliary, rows, nonzeros (of the matrix), feature_nonzeros. A variable takes two
    bounds, an objective and a kind; a row a pointer and two bounds; a nonzero an index and a coefficient. The solver holds
    a copy of all that, and an index and a value more for each variable. Scratch takes the features and the compiler's arrays.
    """
    variables, rows, nonzeros = F.col("primary") + F.col("auxiliary"), F.col("rows"), F.col("nonzeros")
    matrix = (rows + 1) * 8 + nonzeros * 12 + rows * 16
    compiler, solver = variables * 25 + matrix, variables * 37 + matrix
    peak = F.floor((compiler + solver) * F.lit(float(safety))).cast("long")
    return models.withColumns({"compiler_bytes": compiler, "solver_bytes": solver, "scratch_bytes": F.col("feature_nonzeros") * 12 + compiler, "peak_bytes": peak})


def admissions(models: DataFrame, peak_limit: int = 8 << 30, scratch_limit: int = 64 << 30, safety: float = 1.5) -> DataFrame:
    """footprints() with gate and reason. A model of which only the units are known is let through to be measured; a measured
    one must fit the memory, then the scratch space. Counts below nought, or more variables than units, are refused."""
    numbers = ("primary", "auxiliary", "rows", "nonzeros", "feature_nonzeros")
    counted = F.col("rows").isNull() & F.col("nonzeros").isNull()
    least = F.least("planning_units", *numbers)
    reason = (
        F.when(least < 0, "negative dimension")
        .when(F.col("primary") > F.col("planning_units"), "more variables than units")
        .when(F.col("measured") == F.lit(False), "structural_inventory_required")
        .when(F.col("peak_bytes") > peak_limit, "profile_peak_memory_exceeded")
        .when(F.col("scratch_bytes") > scratch_limit, "profile_scratch_space_exceeded")
        .otherwise("admitted")
    )
    known = models.withColumn("measured", ~counted)
    filled = known.withColumns({"primary": F.coalesce("primary", "planning_units").cast("long")} | {c: F.coalesce(c, F.lit(0)).cast("long") for c in numbers[1:]})
    return footprints(filled, safety).withColumns({"gate": F.when(F.col("measured"), "compiled_model").otherwise("structural_inventory"), "reason": reason}).drop("measured")


def footprint(variables: int, rows: int, nonzeros: int, pairs: int = 0, safety: float = 1.5) -> int:
    """Peak bytes of one sparse model: a pair of flexible neighbours adds a variable, two rows and four nonzeros."""
    variables, rows, nonzeros = variables + pairs, rows + 2 * pairs, nonzeros + 4 * pairs
    return int(safety * (variables * 62 + nonzeros * 24 + rows * 48 + 16))


def admit(peak: int, scratch: int, peak_limit: int = 8 << 30, scratch_limit: int = 64 << 30) -> str:
    return "peak_memory" if peak > peak_limit else "scratch" if scratch > scratch_limit else "admitted"
