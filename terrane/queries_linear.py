"""The registered queries of linear programs over planning units, with the same in SQL.

SQL has no solver: programs are made so that their solution is known, or are solved there once for each unit.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import linear, selection
from terrane.queries import UNITS, query, read, units

#: Two rows limit units of low value, at the prices 4 and 2; a unit is worth its size and what it costs at these prices.
KNOWN = """k AS (SELECT p_partkey AS unit, p_size, CASE WHEN p_size <= 34 THEN (p_partkey % 10) / 10.0 ELSE 0 END AS a, CASE WHEN p_size <= 34 AND p_partkey % 3 = 0 THEN 1.0 ELSE 0 END AS b FROM part)"""


@query(f"WITH {KNOWN} SELECT unit, ((CASE WHEN p_size > 40 THEN 1 ELSE 0 END + CASE WHEN p_size > 25 THEN 1 ELSE 0 END) / 2)::DOUBLE AS priority FROM k")
def priority_ranking_rows(spark, d):
    """Two budgets: units above size 40, then those above size 25, though many smaller ones are worth more than some of these."""
    low = F.col("p_size") <= 34
    k = read(spark, d, "part").select(F.col("p_partkey").alias("unit"), "p_size", F.when(low, F.col("p_partkey") % 10 / 10).otherwise(0.0).alias("a"), F.when(low & (F.col("p_partkey") % 3 == 0), 1.0).otherwise(0.0).alias("b"))
    n, first, second, a, b = k.agg(F.count("*"), F.count_if(F.col("p_size") > 40), F.count_if(F.col("p_size") > 25), F.sum(F.when(F.col("p_size") > 25, F.col("a"))), F.sum(F.when(F.col("p_size") > 25, F.col("b")))).first()
    rows = spark.createDataFrame([("a", None, a), ("b", None, b)], "row_id string, low double, high double")
    nonzeros = k.select(F.inline(F.array(*(F.struct(F.lit(c).alias("row_id"), F.col(c).alias("coef")) for c in "ab"))), "unit")
    found = linear.priority(k.select("unit", (F.col("p_size") + 4 * F.col("a") + 2 * F.col("b")).alias("objective")), rows, nonzeros, [first / n, second / n])
    return found.select("unit", F.round("priority", 4).alias("priority"))


DENSITY = "o AS (SELECT *, row_number() OVER (ORDER BY objective / cost DESC, unit) AS k FROM units), budget AS (SELECT 0.3 * sum(cost) AS b FROM units)"


@query(
    f"""WITH {UNITS}, {DENSITY}, s AS (SELECT *, sum(cost) OVER (ORDER BY k) AS upto FROM o),
best AS (SELECT sum(objective * greatest(0, least(1, (b - (upto - cost)) / cost))) AS z FROM s, budget),
asked AS (SELECT unit, k, cost, objective, greatest(0, least(1, (b - (upto - cost)) / cost)) AS x FROM s JOIN part ON p_partkey = unit, budget WHERE p_size = 50),
w AS (SELECT a.unit, sum(s.objective * greatest(0, least(1, (b - (upto - s.cost - CASE WHEN s.k > a.k THEN a.cost ELSE 0 END)) / s.cost))) AS z FROM asked a JOIN s ON s.unit <> a.unit, budget GROUP BY a.unit)
SELECT unit, round(x, 4) AS x, 'replaceable' AS status, round(best.z - w.z, 3) AS loss FROM asked JOIN w USING (unit), best"""
)
def replacement_cost_rows(spark, d):
    """The units of one size are asked for; each that the best uses is solved without, all side by side."""
    u = units(spark, d)
    budget = 0.3 * u.agg(F.sum("cost")).first()[0]
    rows = spark.createDataFrame([("cost", None, budget)], "row_id string, low double, high double")
    asked = read(spark, d, "part").where("p_size = 50").select(F.col("p_partkey").alias("unit"))
    found = linear.replacement(u, rows, u.select(F.lit("cost").alias("row_id"), "unit", F.col("cost").alias("coef")), asked, most=None)
    return found.select("unit", F.abs(F.round("x", 4)).alias("x"), "status", F.round("loss", 3).alias("loss"))


@query(
    f"""WITH {UNITS}, {DENSITY}, s AS (SELECT *, sum(cost) OVER (ORDER BY k) - cost AS start, sum(objective) OVER (ORDER BY k) - objective AS before FROM o),
probes AS (SELECT unit, b + cost AS t FROM s, budget WHERE start < b UNION ALL SELECT NULL, b FROM budget),
v AS (SELECT p.unit, s.before + s.objective * least(1, (t - s.start) / s.cost) AS worth FROM probes p ASOF JOIN s ON p.t >= s.start)
SELECT s.unit, round(coalesce(CASE WHEN v.unit IS NOT NULL THEN least(1, (b - start) / cost) END, 0), 4) AS x, round(coalesce((SELECT worth FROM v WHERE unit IS NULL) - (v.worth - s.objective), 0), 3) AS loss
FROM s LEFT JOIN v ON s.unit = v.unit, budget"""
)
def exclusion_losses(spark, d):
    u = units(spark, d)
    found = selection.exclusions(u, 0.3 * u.agg(F.sum("cost")).first()[0])
    return found.select("unit", F.round("x", 4).alias("x"), F.round("loss", 3).alias("loss"))


@query(
    f"""WITH {UNITS}, t AS (SELECT 0.3 * sum(cost) AS a, 0.25 * sum(objective) AS b FROM units), o AS (SELECT *, sum(cost) OVER w AS upto, sum(objective) OVER w AS so_far FROM units, t WINDOW w AS (ORDER BY objective / (cost / a + objective / b) DESC, unit)),
g AS (SELECT coalesce(sum(objective), 0) AS greedy FROM o WHERE upto <= a + 1e-9 AND so_far <= b + 1e-9)
SELECT true AS feasible, true AS as_good_as_greedy, round(greedy, 2)::DOUBLE AS greedy FROM g"""
)
def warm_start_rows(spark, d):
    """A selection under a row of costs and one of amounts: whether it keeps both, and is worth what a greedy prefix is."""
    u = units(spark, d)
    a, b = (share * total for share, total in zip((0.3, 0.25), u.agg(F.sum("cost"), F.sum("objective")).first(), strict=True))
    rows = spark.createDataFrame([("cost", None, a), ("amount", None, b)], "row_id string, low double, high double")
    nonzeros = u.select(F.inline(F.array(F.struct(F.lit("cost").alias("row_id"), F.col("cost").alias("coef")), F.struct(F.lit("amount").alias("row_id"), F.col("objective").alias("coef")))), "unit")
    found = selection.warm_start(u, rows, nonzeros).join(u.hint("merge"), "unit").where("x > 0")
    key = F.col("objective") / (F.col("cost") / a + F.col("objective") / b)
    prefix = selection.running_sums(u.withColumn("key", key), [F.desc("key"), F.asc("unit")], ["cost", "objective"]).where((F.col("sum_cost") <= a + 1e-9) & (F.col("sum_objective") <= b + 1e-9))
    sums = found.agg(F.sum("cost").alias("cost"), F.sum("objective").alias("worth"), F.max("x").alias("x")).crossJoin(prefix.agg(F.coalesce(F.sum("objective"), F.lit(0.0)).alias("greedy")))  # one row each
    kept = (F.col("cost") <= a + 1e-6) & (F.col("worth") <= b + 1e-6) & (F.col("x") == 1)
    return sums.select(kept.alias("feasible"), (F.col("worth") >= F.col("greedy") - 1e-6).alias("as_good_as_greedy"), F.round("greedy", 2).alias("greedy"))
