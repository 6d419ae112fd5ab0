"""Checks of a solution by the model alone, and its way back to cells.

variables: col, objective, low, high, integer. rows: row, low, high. nonzeros: row, col, coef. columns: col, x. A bound
that is NULL, NaN or infinite is none. Empty tables violate nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators.compiler import bound

#: Failures in the order they are reported in.
FAILURES = ("variable_bound_violation", "integrality_violation", "constraint_violation", "objective_mismatch")


def beyond(value: Column) -> Column:
    """How far a value lies outside of low and high."""
    return F.greatest(F.coalesce(bound("low") - value, F.lit(0.0)), F.coalesce(value - bound("high"), F.lit(0.0)), F.lit(0.0))


def validated(variables: DataFrame, rows: DataFrame, nonzeros: DataFrame, columns: DataFrame, offset: float = 0.0, reported: float | None = None, tolerance: float = 1e-6) -> DataFrame:
    """One row: objective, bound_violation, integrality_violation, row_violation, failures. Values that a column lacks are an error."""
    x = F.coalesce("x", F.raise_error(F.lit("a variable has no value")).cast("double"))
    v = variables.join(columns.select("col", "x"), "col", "left").withColumn("x", x)
    own = v.agg(
        F.coalesce(F.sum(F.col("objective") * F.col("x")), F.lit(0.0)).alias("objective"),
        F.coalesce(F.max(beyond(F.col("x"))), F.lit(0.0)).alias("bound_violation"),
        F.coalesce(F.max(F.when(F.col("integer"), F.abs(F.col("x") - F.rint("x")))), F.lit(0.0)).alias("integrality_violation"),
    ).withColumn("objective", F.col("objective") + offset)
    activity = nonzeros.join(columns, "col").groupBy("row").agg(F.sum(F.col("coef") * F.col("x")).alias("activity"))
    of_rows = rows.join(activity, "row", "left").agg(F.coalesce(F.max(beyond(F.coalesce("activity", F.lit(0.0)))), F.lit(0.0)).alias("row_violation"))
    mismatch = F.lit(False) if reported is None else F.abs(F.col("objective") - reported) > tolerance * F.greatest(F.lit(1.0), F.abs("objective"))
    broken = (F.col("bound_violation") > tolerance, F.col("integrality_violation") > tolerance, F.col("row_violation") > tolerance, mismatch)
    failures = F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in zip(broken, FAILURES, strict=True))))
    return own.crossJoin(of_rows).withColumn("failures", failures)  # one row each


def both(candidates: DataFrame, fixed: DataFrame) -> DataFrame:
    """Units that are candidates and fixed; there must be none."""
    return candidates.select("unit").intersect(fixed.select("unit"))


def selected_units(candidates: DataFrame, fixed: DataFrame) -> DataFrame:
    """unit of the candidates (unit, x) of half or more and of what is fixed in (unit, state), sorted; a unit that is both is an error."""
    rows = candidates.select("unit", (F.col("x") >= 0.5).alias("chosen")).unionByName(fixed.select("unit", (F.col("state") == 1).alias("chosen")))
    twice = F.when(F.col("n") > 1, F.raise_error(F.lit("a unit is both candidate and fixed")).cast("boolean")).otherwise(F.col("chosen"))
    return rows.groupBy("unit").agg(F.count("*").alias("n"), F.max("chosen").alias("chosen")).where(twice).select("unit").orderBy("unit")


def rebuilt(candidates: DataFrame, fixed: DataFrame, units: int) -> DataFrame:
    """unit, x of candidates (unit, x) and fixed ones (unit, state); if they aren't the given number of units, each once, it's an error."""
    rows = candidates.select("unit", F.col("x").cast("double").alias("x")).unionByName(fixed.select("unit", F.col("state").cast("double").alias("x")))
    n, distinct = rows.agg(F.count("*"), F.count_distinct("unit")).first()
    if n != units or distinct != units:
        raise ValueError(f"{n} values of {distinct} units instead of {units}")
    return rows


def scattered(units: DataFrame, decisions: DataFrame, integer: bool) -> DataFrame:
    """units (variable_index, ...) with decision (half or more) and, if not integer, allocation between 0 and 1."""
    rows = units.join(decisions, "variable_index").withColumn("decision", (F.col("x") >= 0.5).cast("int"))
    return rows.drop("x") if integer else rows.withColumn("allocation", F.least(F.greatest(F.col("x"), F.lit(0.0)), F.lit(1.0))).drop("x")


def decomposed(values: DataFrame, coefficients: DataFrame, decisions: DataFrame) -> DataFrame:
    """layer, raw (sum of amount times x), contribution (raw times the layer's coefficient); a layer without values has 0."""
    raw = values.join(decisions, "unit").groupBy("layer").agg(F.sum(F.col("amount") * F.col("x")).alias("raw"))
    return coefficients.join(raw, "layer", "left").select("layer", F.coalesce("raw", F.lit(0.0)).alias("raw"), (F.col("coefficient") * F.coalesce("raw", F.lit(0.0))).alias("contribution"))


def close(a: Column, b: Column, relative: float = 1e-7, absolute: float = 1e-7) -> Column:
    """Whether a is as good as b; NaN is close to nothing."""
    return ~F.isnan(a) & ~F.isnan(b) & ((a == b) | (F.abs(a - b) <= absolute + relative * F.abs(b)))


def replacement(best: Column, without: Column, tolerance: float = 1e-6) -> tuple[Column, Column]:
    """Absolute and relative loss of an optimum that falls to another (NULL: infeasible without the unit, so no loss is known).
    A rise beyond the tolerance is an error."""
    limit = tolerance * F.greatest(F.lit(1.0), F.abs(best), F.abs(without))
    loss = F.when(without - best > limit, F.raise_error(F.lit("the optimum rose without the unit")).cast("double")).otherwise(F.greatest(F.lit(0.0), best - without))
    return F.when(without.isNotNull(), loss), F.when(without.isNotNull() & (best != 0), loss / F.abs(best))


def strictly_rising(df: DataFrame, order: str) -> DataFrame:
    """Values of a column that occur more than once: the rest rises strictly when sorted."""
    return df.groupBy(order).agg(F.count("*").alias("n")).where("n > 1").select(order)


def unlike(names: DataFrame, contracts: DataFrame, key: str) -> DataFrame:
    """key, missing: names without a contract (contract) and contracts that nothing names (name)."""
    a, b = names.select(key).distinct().withColumn("named", F.lit(True)), contracts.select(key).distinct().withColumn("known", F.lit(True))
    missing = F.when(F.col("known").isNull(), "contract").when(F.col("named").isNull(), "name")
    return a.join(b, key, "full_outer").select(key, missing.alias("missing")).where("missing IS NOT NULL")
