"""From a prepared problem to the tables of a sparse model: variables, rows and nonzeros, after what fixed units decide.

states: unit, state (-1 or NULL flexible, 0 fixed out, 1 fixed in). edges: a, b. constraints: feature, low, high (either
may be NULL). relations: feature, unit, coef. An infinity or NaN as a bound counts as none. Empty tables give empty ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.shared import save
from terrane.operators.graph import with_states
from terrane.operators.grid import numbered


def flexible(state: str) -> Column:
    return F.coalesce(F.col(state), F.lit(-1)) < 0


def bound(column: str) -> Column:
    """NULL unless the bound is finite."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def attainable(edges: DataFrame, states: DataFrame) -> DataFrame:
    """The edges of which no end is fixed out."""
    out = states.where("state = 0").select("unit")
    for end in ("a", "b"):
        edges = edges.join(out.withColumnRenamed("unit", end), end, "left_anti")
    return edges.select("a", "b")


def reward(strength: float, edges: int) -> float:
    """What one selected pair is worth: the strength is shared by the attainable edges."""
    return strength / edges if edges else 0.0


def split_bounds(constraints: DataFrame) -> DataFrame:
    """feature, side (minimum or maximum), low, high: each finite bound is a row of its own."""
    sides = F.array(F.struct(F.lit("minimum").alias("side"), bound("low").alias("low"), F.lit(None).cast("double").alias("high")), F.struct(F.lit("maximum").alias("side"), F.lit(None).cast("double").alias("low"), bound("high").alias("high")))
    return constraints.select("feature", F.inline(sides)).where("low IS NOT NULL OR high IS NOT NULL")


def simplified_rows(constraints: DataFrame, relations: DataFrame, states: DataFrame) -> DataFrame:
    """feature, side, low, high (less what units fixed in contribute), least, greatest (possible activity of the flexible
    units), nonzeros, and status: kept, redundant (no activity breaks it) or infeasible (no flexible unit left to meet it)."""
    c = F.col("coef")
    free = flexible("state")
    sums = relations.join(states.select("unit", "state"), "unit").groupBy("feature").agg(
        F.coalesce(F.sum(F.when(F.col("state") == 1, c)), F.lit(0.0)).alias("fixed"),
        F.coalesce(F.sum(F.when(free & (c < 0), c)), F.lit(0.0)).alias("least"),
        F.coalesce(F.sum(F.when(free & (c > 0), c)), F.lit(0.0)).alias("greatest"),
        F.count_if(free & (c != 0)).alias("nonzeros"),
    )
    rows = split_bounds(constraints).join(sums, "feature", "left").fillna(0, ["fixed", "least", "greatest", "nonzeros"])
    rows = rows.withColumns({"low": F.col("low") - F.col("fixed"), "high": F.col("high") - F.col("fixed")}).drop("fixed")
    met = lambda low, high: F.coalesce(F.col("low") <= low, F.lit(True)) & F.coalesce(F.col("high") >= high, F.lit(True))
    status = F.when(met(F.col("least"), F.col("greatest")), "redundant").when((F.col("nonzeros") == 0) & ~met(F.lit(0.0), F.lit(0.0)), "infeasible")
    return rows.withColumn("status", F.when(status.isNotNull(), status).when(F.col("nonzeros") == 0, "redundant").otherwise("kept"))


def feasible(rows: DataFrame) -> DataFrame:
    """rows of simplified_rows() that stay; a row that no unit can meet any more raises."""
    text = F.concat(F.lit("constant row is infeasible: "), F.col("feature").cast("string"), F.lit("_"), F.col("side"))
    return rows.where(F.when(F.col("status") == "infeasible", F.raise_error(text).cast("boolean")).otherwise(F.col("status") == "kept"))


def folded_edges(edges: DataFrame, states: DataFrame) -> DataFrame:
    """a, b, kind of each edge, and unit: constant (both fixed in), unary (one fixed in; unit is the flexible end), dropped
    (an end is fixed out) or pairwise (both flexible)."""
    rows = with_states(edges, states, ["state"])
    free_a, free_b = flexible("state_a"), flexible("state_b")
    out = (F.col("state_a") == 0) | (F.col("state_b") == 0)
    kind = F.when(F.coalesce(out, F.lit(False)), "dropped").when(free_a & free_b, "pairwise").when(free_a | free_b, "unary").otherwise("constant")
    unit = F.when(kind == "unary", F.when(free_a, F.col("a")).otherwise(F.col("b")))
    return rows.select("a", "b", kind.alias("kind"), unit.alias("unit"))


@dataclass(frozen=True)
class Model:
    """variables: col, unit (NULL for a pair), a, b, objective, low, high, integer. rows: row, name, low, high.
    nonzeros: row, col, coef. offset: what units fixed in and their pairs are worth."""

    variables: DataFrame
    rows: DataFrame
    nonzeros: DataFrame
    offset: float


def build(units: DataFrame, edges: DataFrame, constraints: DataFrame, relations: DataFrame, strength: float, integer: bool = True, target: bool = False) -> Model:
    """units: unit, objective, state. Columns: flexible units by id, then a continuous variable for each pair of them.

    Rows: features by name, minimum before maximum; if target, the sum of all units (bounds 0, set later); then z <= x
    for the first end of every pair, then for the second.
    """
    folded = save(folded_edges(edges, units))
    n, constant = folded.agg(F.count_if(F.col("kind") != "dropped"), F.count_if(F.col("kind") == "constant")).first()  # n: attainable ones
    worth = reward(strength, n)
    bumps = folded.where("kind = 'unary'").groupBy("unit").agg(F.count("*").alias("k"))
    primary = numbered(units.where(flexible("state")).join(bumps, "unit", "left"), [F.asc("unit")], "col")
    primary = primary.select("col", "unit", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), (F.col("objective") + worth * F.coalesce("k", F.lit(0))).alias("objective"), F.lit(integer).alias("integer"))
    count = primary.count()
    pairs = numbered(folded.where("kind = 'pairwise'").select("a", "b"), [F.asc("a"), F.asc("b")], "pair")
    pairs_count = pairs.count()
    auxiliary = pairs.select((F.col("pair") + count).alias("col"), F.lit(None).cast("long").alias("unit"), "a", "b", F.lit(worth).alias("objective"), F.lit(False).alias("integer"))
    variables = primary.unionByName(auxiliary).withColumns({"low": F.lit(0.0), "high": F.lit(1.0)})

    kept = numbered(feasible(simplified_rows(constraints, relations, units)), [F.asc("feature"), F.desc("side")], "row")  # minimum, then maximum
    first = kept.count()
    rows = kept.select("row", F.concat_ws("_", "feature", "side").alias("name"), "low", "high")
    columns = primary.select("unit", "col")
    nonzeros = relations.where("coef <> 0").join(kept.select("feature", "row"), "feature").join(columns, "unit").select("row", "col", "coef")
    if target:
        rows = rows.unionByName(primary.sparkSession.range(1).select(F.lit(first).cast("long").alias("row"), F.lit("allocation_target").alias("name"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high")))
        nonzeros = nonzeros.unionByName(columns.select(F.lit(first).cast("long").alias("row"), "col", F.lit(1.0).alias("coef")))
        first += 1
    for k, end in enumerate(("a", "b")):
        each = pairs.select((F.col("pair") + first + k * pairs_count).alias("row"), (F.col("pair") + count).alias("z"), F.col(end).alias("unit")).join(columns, "unit")
        rows = rows.unionByName(each.select("row", F.lit(f"pair_{k + 1}").alias("name"), F.lit(None).cast("double").alias("low"), F.lit(0.0).alias("high")))
        nonzeros = nonzeros.unionByName(each.select("row", F.inline(F.array(F.struct(F.col("z").alias("col"), F.lit(1.0).alias("coef")), F.struct("col", F.lit(-1.0).alias("coef"))))))
    fixed = units.where("state = 1").agg(F.coalesce(F.sum("objective"), F.lit(0.0))).first()[0]
    return Model(variables, rows, nonzeros, fixed + worth * constant)


def dimensions(constraints: DataFrame, relations: DataFrame) -> DataFrame:
    """rows, nonzeros of the rows that the bounds of the features ask for, before any is simplified."""
    bounds = split_bounds(constraints).groupBy("feature").agg(F.count("*").alias("k"))
    nnz = relations.where("coef <> 0").groupBy("feature").agg(F.count("*").alias("n"))
    return bounds.join(nnz, "feature", "left").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("k") * F.coalesce("n", F.lit(0))), F.lit(0)).alias("nonzeros"))


def statistics(before: DataFrame, after: DataFrame, relations: DataFrame) -> DataFrame:
    """One row of counts of a reduction: units, fixed in, fixed out, derived (flexible before, out after), left, and
    nonzeros before and after. before and after: unit, state."""
    states = before.select("unit", F.col("state").alias("was")).join(after.select("unit", "state"), "unit")
    units = states.agg(
        F.count("*").alias("units"),
        F.count_if(F.col("state") == 1).alias("fixed_in"),
        F.count_if(F.col("state") == 0).alias("fixed_out"),
        F.count_if(flexible("was") & (F.col("state") == 0)).alias("derived_out"),
        F.count_if(flexible("state")).alias("left"),
    )
    nnz = relations.where("coef <> 0").join(after.select("unit", "state"), "unit").agg(F.count("*").alias("nonzeros"), F.count_if(flexible("state")).alias("nonzeros_left"))
    return units.crossJoin(nnz)  # one row each


def bad_vector(vector: DataFrame, variables: int) -> DataFrame:
    """Entries of a sparse vector (variable, value) that are out of range, repeated or not finite, with the problem."""
    rows = vector.groupBy("variable").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))).alias("odd"))
    problem = F.when(F.col("variable").isNull() | ~F.col("variable").between(0, variables - 1), "out of range").when(F.col("n") > 1, "repeated").when(F.col("odd") > 0, "not finite")
    return rows.select("variable", problem.alias("problem")).where("problem IS NOT NULL")


def overridden(bounds: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """bounds (key, low, high) with those of a scenario in place of theirs; the old ones stay in bounds, to go back to."""
    new = overrides.select(key, F.col("low").alias("new_low"), F.col("high").alias("new_high"), F.lit(True).alias("given"))
    pick = lambda c: F.when(F.col("given"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    return bounds.join(new, key, "left").select(key, pick("low"), pick("high"))


def with_pairs(allocations: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, z: the value of each pair's variable, the lesser of its ends."""
    return with_states(pairs, allocations, ["x"]).select("a", "b", F.least("x_a", "x_b").alias("z"))
