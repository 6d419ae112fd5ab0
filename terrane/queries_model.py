"""The registered queries of model building, checks, stored states and scalar functions, with the same in SQL.

part is the grid of planning units, lineitem relates units (parts) to features (suppliers); orders stand for runs, lineitem
for their artifacts, customers for profiles, suppliers and nations for projects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import contracts, geo, masks, scalars
from terrane.functions.shared import save
from terrane.operators import compiler, graph, grid, metadata, problems, resample, states, validation
from terrane.operators import model as objectives
from terrane.queries import _NZ, CELLS, EDGES, ORACLE, SCALES, cells, nonzeros, problem, query, read, values
from terrane.queries import states as unit_states
from terrane.sources import tables
from terrane.streaming import changes

R4 = lambda c: F.round(c, 4).alias(c)


# --- model -----------------------------------------------------------------------------------------------------------
OBJECTIVE = "o AS (SELECT unit, state, (p_size - 30) / 10.0::DOUBLE AS objective FROM states)"
CONSTRAINTS = "k AS (SELECT s_suppkey AS feature, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal / 100 - 40 END AS low, CASE WHEN s_suppkey % 4 = 0 THEN 30.0 WHEN s_suppkey % 5 = 0 THEN 1e9 END AS high FROM supplier)"
SIDES = "sides AS (SELECT feature, 'minimum' AS side, low, NULL::DOUBLE AS high FROM k WHERE low IS NOT NULL UNION ALL SELECT feature, 'maximum', NULL, high FROM k WHERE high IS NOT NULL)"
SUMS = "sums AS (SELECT row_id AS feature, coalesce(sum(coef) FILTER (state = 1), 0) AS fixed, coalesce(sum(coef) FILTER (state = -1 AND coef < 0), 0) AS least, coalesce(sum(coef) FILTER (state = -1 AND coef > 0), 0) AS greatest, count(*) FILTER (state = -1 AND coef <> 0) AS nonzeros FROM nz JOIN states USING (unit) GROUP BY 1)"
ROWS = """rws AS (SELECT feature, side, low - coalesce(fixed, 0) AS low, high - coalesce(fixed, 0) AS high, coalesce(least, 0) AS least, coalesce(greatest, 0) AS greatest, coalesce(nonzeros, 0) AS nonzeros FROM sides LEFT JOIN sums USING (feature)),
judged AS (SELECT *, CASE WHEN coalesce(low <= least, true) AND coalesce(high >= greatest, true) THEN 'redundant' WHEN nonzeros = 0 AND NOT (coalesce(low <= 0, true) AND coalesce(high >= 0, true)) THEN 'infeasible' WHEN nonzeros = 0 THEN 'redundant' ELSE 'kept' END AS status FROM rws)"""
MODEL = f"{EDGES}, {OBJECTIVE}, {_NZ}, {CONSTRAINTS}, {SIDES}, {SUMS}, {ROWS}"
FOLDED = "f AS (SELECT a, b, CASE WHEN sa = 0 OR sb = 0 THEN 'dropped' WHEN sa = -1 AND sb = -1 THEN 'pairwise' WHEN sa = -1 OR sb = -1 THEN 'unary' ELSE 'constant' END AS kind, CASE WHEN sa = 0 OR sb = 0 THEN NULL WHEN sa = -1 AND sb = 1 THEN a WHEN sb = -1 AND sa = 1 THEN b END AS unit FROM edges)"
WORTH = "w AS (SELECT 12.0 / greatest(count(*), 1) AS worth FROM edges WHERE sa <> 0 AND sb <> 0)"
COLUMNS = """prim AS (SELECT row_number() OVER (ORDER BY unit) - 1 AS col, unit, objective + worth * coalesce(n, 0) AS objective FROM o LEFT JOIN (SELECT unit, count(*) AS n FROM f WHERE kind = 'unary' GROUP BY 1) USING (unit), w WHERE state = -1),
pairs AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS pair, a, b FROM f WHERE kind = 'pairwise'), n AS (SELECT count(*) AS n FROM prim), m AS (SELECT count(*) AS m FROM pairs),
kept AS (SELECT row_number() OVER (ORDER BY feature, side DESC) - 1 AS row, feature, side, low, high FROM judged WHERE status = 'kept'), t AS (SELECT count(*) AS t FROM kept)"""


def objective(spark, d) -> DataFrame:
    return unit_states(spark, d).select("unit", "row", "col", "state", ((F.col("p_size") - 30) / F.lit(10.0)).alias("objective"))


def constraints(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    high = F.when(k % 4 == 0, F.lit(30.0)).when(k % 5 == 0, F.lit(1e9))
    return read(spark, d, "supplier").select(k.alias("feature"), F.when(k % 3 == 0, F.col("s_acctbal") / 100 - 40).alias("low"), high.alias("high"))


def relations(spark, d) -> DataFrame:
    return nonzeros(spark, d).withColumnRenamed("row_id", "feature")


def model(spark, d) -> compiler.Model:
    o = save(objective(spark, d))
    return compiler.build(o.drop("row", "col"), save(graph.rook_edges(o)), constraints(spark, d), save(relations(spark, d)), 12.0, target=True)


@query(f"WITH {EDGES} SELECT a, b FROM edges WHERE sa <> 0 AND sb <> 0")
def attainable_edges(spark, d):
    s = unit_states(spark, d)
    return compiler.attainable(graph.rook_edges(s), s.select("unit", "state"))


@query(f"WITH {EDGES}, {FOLDED} SELECT * FROM f")
def edge_folding(spark, d):
    s = unit_states(spark, d)
    return compiler.folded_edges(graph.rook_edges(s), s)


@query(f"WITH {MODEL} SELECT feature, side, round(low, 4) AS low, round(high, 4) AS high, round(least, 4) AS least, round(greatest, 4) AS greatest, nonzeros, status FROM judged")
def row_simplification(spark, d):
    rows = compiler.simplified_rows(constraints(spark, d), relations(spark, d), unit_states(spark, d))
    return rows.select("feature", "side", *map(R4, ("low", "high", "least", "greatest")), "nonzeros", "status")


@query(
    f"WITH {MODEL}, {FOLDED}, {WORTH}, {COLUMNS} SELECT col, unit, NULL::BIGINT AS a, NULL::BIGINT AS b, round(objective, 6)::DOUBLE AS objective, true AS integer FROM prim "
    "UNION ALL SELECT pair + n, NULL, a, b, round(worth, 6)::DOUBLE, false FROM pairs, n, w"
)
def model_variables(spark, d):
    return model(spark, d).variables.select("col", "unit", "a", "b", F.round("objective", 6).alias("objective"), "integer")


@query(
    f"WITH {MODEL}, {FOLDED}, {WORTH}, {COLUMNS} SELECT row, feature || '_' || side AS name, round(low, 4)::DOUBLE AS low, round(high, 4)::DOUBLE AS high FROM kept UNION ALL SELECT t, 'allocation_target', 0.0, 0.0 FROM t "
    "UNION ALL SELECT pair + t + 1, 'pair_1', NULL, 0.0 FROM pairs, t UNION ALL SELECT pair + t + 1 + m, 'pair_2', NULL, 0.0 FROM pairs, t, m"
)
def model_rows(spark, d):
    return model(spark, d).rows.select("row", "name", R4("low"), R4("high"))


@query(
    f"WITH {MODEL}, {FOLDED}, {WORTH}, {COLUMNS} SELECT row, col, round(coef, 4)::DOUBLE AS coef FROM kept JOIN nz ON feature = row_id JOIN prim USING (unit) WHERE coef <> 0 UNION ALL SELECT t, col, 1.0 FROM prim, t "
    "UNION ALL SELECT pair + t + 1, unnest([pair + n, col]), unnest([1.0, -1.0]) FROM pairs JOIN prim ON a = unit, t, n UNION ALL SELECT pair + t + 1 + m, unnest([pair + n, col]), unnest([1.0, -1.0]) FROM pairs JOIN prim ON b = unit, t, n, m"
)
def model_nonzeros(spark, d):
    return model(spark, d).nonzeros.select("row", "col", R4("coef"))


@query(f"WITH {MODEL} SELECT count(*) AS rows, coalesce(sum(n), 0)::BIGINT AS nonzeros FROM sides LEFT JOIN (SELECT row_id AS feature, count(*) AS n FROM nz WHERE coef <> 0 GROUP BY 1) USING (feature)")
def model_dimensions(spark, d):
    return compiler.dimensions(constraints(spark, d), relations(spark, d))


NEEDED = "kept_units AS (SELECT DISTINCT unit FROM nz JOIN k ON feature = row_id WHERE coef > 0 AND low IS NOT NULL OR coef < 0 AND high IS NOT NULL)"
NEAR = "e AS (SELECT a AS unit, b AS other FROM edges UNION ALL SELECT b, a FROM edges)"
ROUNDS = """r AS (SELECT unit, objective, state, 0 AS round, true AS changed FROM o UNION ALL
  SELECT unit, objective, new, round + 1, bool_or(new <> state) OVER () FROM (
    SELECT r.*, CASE WHEN r.state = -1 AND objective + {strength} * coalesce(n, 0) <= 1e-12 {spared} THEN 0 ELSE r.state END AS new
    FROM r LEFT JOIN (SELECT e.unit, count(*) AS n FROM e JOIN r ON e.other = r.unit WHERE r.state <> 0 GROUP BY 1) AS g USING (unit) WHERE changed))"""


@query(f"WITH RECURSIVE {MODEL}, {NEEDED}, {NEAR}, {ROUNDS.format(strength=0.5, spared='AND unit NOT IN (SELECT unit FROM kept_units)')} SELECT unit, arg_max(state, round) AS state FROM r GROUP BY 1")
def presolve_protected(spark, d):
    o = objective(spark, d)
    kept = graph.protected(nonzeros(spark, d), constraints(spark, d).withColumnRenamed("feature", "row_id"))
    return graph.reduce_fixpoint(o.select("unit", "objective", "state"), graph.rook_edges(o), 0.5, save, kept)[0].select("unit", "state")


ORACLE["presolve_fixpoint"] = f"WITH RECURSIVE {EDGES}, {OBJECTIVE}, {NEAR}, {ROUNDS.format(strength=0.25, spared='')} SELECT unit, arg_max(state, round) AS state FROM r GROUP BY 1"


@query(
    f"WITH RECURSIVE {MODEL}, {NEAR}, {ROUNDS.format(strength=0.25, spared='')}, z AS (SELECT unit, arg_max(state, round) AS state FROM r GROUP BY 1), c AS (SELECT states.state AS was, z.state AS state FROM states JOIN z USING (unit)) "
    "SELECT count(*) AS units, count(*) FILTER (state = 1) AS fixed_in, count(*) FILTER (state = 0) AS fixed_out, count(*) FILTER (was = -1 AND state = 0) AS derived_out, count(*) FILTER (state = -1) AS left, "
    "(SELECT count(*) FROM nz JOIN z USING (unit) WHERE coef <> 0) AS nonzeros, (SELECT count(*) FROM nz JOIN z USING (unit) WHERE coef <> 0 AND state = -1) AS nonzeros_left FROM c"
)
def reduction_statistics(spark, d):
    o = objective(spark, d)
    after = graph.reduce_fixpoint(o.select("unit", "objective", "state"), graph.rook_edges(o), 0.25, save)[0]
    return compiler.statistics(o, after, relations(spark, d))


@query("SELECT l_partkey % 97 AS variable, CASE WHEN l_partkey % 97 > 90 THEN 'out of range' WHEN count(*) > 1 THEN 'repeated' END AS problem FROM lineitem GROUP BY 1 HAVING problem IS NOT NULL")
def sparse_vector_problems(spark, d):
    v = read(spark, d, "lineitem").select((F.col("l_partkey") % 97).alias("variable"), F.col("l_quantity").alias("value"))
    return compiler.bad_vector(v, 91)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_acctbal END AS low, CASE WHEN s_suppkey % 2 = 0 THEN 5.0 ELSE s_acctbal + 1 END AS high FROM supplier")
def scenario_overrides(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 1).alias("high"))
    new = s.where("s_suppkey % 2 = 0").select("s_suppkey", F.lit(None).cast("double").alias("low"), F.lit(5.0).alias("high"))
    return compiler.overridden(s, new, "s_suppkey")


@query(f"WITH {EDGES}, s AS (SELECT unit, (p_size % 5) / 4.0::DOUBLE AS x FROM cells) SELECT a, b, least(p.x, q.x) AS z FROM edges JOIN s p ON p.unit = a JOIN s q ON q.unit = b WHERE sa = -1 AND sb = -1")
def pair_auxiliaries(spark, d):
    s = unit_states(spark, d)
    pairs = compiler.folded_edges(graph.rook_edges(s), s).where("kind = 'pairwise'")
    return compiler.with_pairs(s.select("unit", ((F.col("p_size") % 5) / F.lit(4.0)).alias("x")), pairs)


# --- checks ----------------------------------------------------------------------------------------------------------
@query(
    f"WITH {CELLS}, {_NZ}, {CONSTRAINTS}, v AS (SELECT unit, (p_size - 30) / 10.0::DOUBLE AS objective, (p_size % 7) / 4.0::DOUBLE AS x, p_size % 2 = 0 AS integer FROM cells), act AS (SELECT row_id AS feature, sum(coef * x) AS activity FROM nz JOIN v USING (unit) GROUP BY 1) "
    "SELECT round(sum(objective * x) + 2, 4) AS objective, round(max(greatest(0 - x, x - 1, 0)), 4) AS bound_violation, round(max(abs(x - round_even(x, 0))) FILTER (integer), 4) AS integrality_violation, "
    "(SELECT round(max(greatest(coalesce(low - coalesce(activity, 0), 0), coalesce(coalesce(activity, 0) - high, 0), 0)), 4) FROM k LEFT JOIN act USING (feature)) AS row_violation, 'variable_bound_violation,integrality_violation,constraint_violation,objective_mismatch' AS failures FROM v"
)
def solution_validation(spark, d):
    c = cells(spark, d)
    v = c.select(F.col("unit").alias("col"), ((F.col("p_size") - 30) / F.lit(10.0)).alias("objective"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high"), (F.col("p_size") % 2 == 0).alias("integer"))
    x = c.select(F.col("unit").alias("col"), ((F.col("p_size") % 7) / F.lit(4.0)).alias("x"))
    nz = nonzeros(spark, d).select(F.col("row_id").alias("row"), F.col("unit").alias("col"), "coef")
    got = validation.validated(v, constraints(spark, d).withColumnRenamed("feature", "row"), nz, x, 2.0, -1e12)
    return got.select(*map(R4, ("objective", "bound_violation", "integrality_violation", "row_violation")), F.array_join("failures", ",").alias("failures"))


@query(f"WITH {SCALES}, x AS (SELECT p_partkey AS unit, (p_size % 5) / 4.0::DOUBLE AS x FROM part), r AS (SELECT layer, sum(amount * x) AS raw FROM vals JOIN x USING (unit) GROUP BY 1) SELECT layer, round(coalesce(raw, 0), 2) AS raw, round(coefficient * coalesce(raw, 0), 6) AS contribution FROM n LEFT JOIN r USING (layer)")
def objective_decomposition(spark, d):
    coefficients = objectives.normalised(F.broadcast(problem(spark)).join(objectives.top_k_scale(values(spark, d), 20), "layer", "left"))
    x = cells(spark, d).select("unit", ((F.col("p_size") % 5) / F.lit(4.0)).alias("x"))
    return validation.decomposed(values(spark, d), coefficients, x).select("layer", F.round("raw", 2).alias("raw"), F.round("contribution", 6).alias("contribution"))


@query(f"WITH {CELLS}, u AS (SELECT unit, row_number() OVER (ORDER BY row // 16, col // 16, row, col) - 1 AS variable_index, p_size FROM cells WHERE price BETWEEN 920 AND 1800) SELECT unit, variable_index, ((p_size % 7) / 5.0 >= 0.5)::INT AS decision, least((p_size % 7) / 5.0, 1)::DOUBLE AS allocation FROM u")
def decision_scatter(spark, d):
    u = grid.dense_index(grid.in_tiles(cells(spark, d), 16), F.expr("price BETWEEN 920 AND 1800"))
    x = u.select("variable_index", ((F.col("p_size") % 7) / F.lit(5.0)).alias("x"))
    return validation.scattered(u.select("unit", "variable_index"), x, False)


CHOSEN = "SELECT unit FROM states WHERE state = -1 AND (p_size % 5) / 4.0 >= 0.5 UNION ALL SELECT unit FROM states WHERE state = 1"


def candidates(spark, d) -> tuple[DataFrame, DataFrame]:
    s = unit_states(spark, d)
    return s.where("state = -1").select("unit", ((F.col("p_size") % 5) / F.lit(4.0)).alias("x")), s.where("state <> -1").select("unit", "state")


@query(f"WITH {STATES} {CHOSEN}" if (STATES := EDGES.split(", edges AS")[0]) else "")
def selected_unit_ids(spark, d):
    return validation.selected_units(*candidates(spark, d))


@query(f"WITH {STATES} SELECT unit, CASE WHEN state = -1 THEN (p_size % 5) / 4.0 ELSE state END::DOUBLE AS x FROM states")
def source_order_values(spark, d):
    c, f = candidates(spark, d)
    return validation.rebuilt(c, f, cells(spark, d).count())


@query("SELECT p_partkey AS unit FROM part WHERE p_size % 2 = 0 AND p_size % 3 = 0")
def candidate_fixed_overlap(spark, d):
    c = cells(spark, d)
    return validation.both(c.where("p_size % 2 = 0"), c.where("p_size % 3 = 0"))


@query("SELECT unit, CASE WHEN known THEN greatest(0, 100.0 - w) END AS loss, CASE WHEN known THEN greatest(0, 100.0 - w) / 100 END AS share FROM (SELECT p_partkey AS unit, p_size % 5 <> 0 AS known, (100 - p_size % 20)::DOUBLE AS w FROM part)")
def replacement_cost(spark, d):
    without = F.when(F.col("p_size") % 5 != 0, (100 - F.col("p_size") % 20).cast("double"))
    loss, share = validation.replacement(F.lit(100.0), without)
    return cells(spark, d).select("unit", loss.alias("loss"), share.alias("share"))


@query("SELECT p_size FROM part GROUP BY 1 HAVING count(*) > 1")
def repeated_values(spark, d):
    return validation.strictly_rising(read(spark, d, "part").select("p_size"), "p_size")


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'contract' ELSE 'name' END AS missing FROM (SELECT DISTINCT c_custkey % 50 AS k FROM customer) a FULL JOIN (SELECT DISTINCT n_nationkey + 10 AS k FROM nation) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def layers_and_contracts(spark, d):
    names, contracts = read(spark, d, "customer").select((F.col("c_custkey") % 50).alias("k")), read(spark, d, "nation").select((F.col("n_nationkey") + 10).cast("long").alias("k"))
    return validation.unlike(names, contracts, "k")


# --- stored states ---------------------------------------------------------------------------------------------------
RUNS = "runs AS (SELECT o_orderkey AS run_id, ['queued', 'running', 'completed', 'failed', 'cancelled'][o_orderkey % 5 + 1] AS status, CASE WHEN o_orderkey % 4 = 0 THEN 'preparation' ELSE 'discrete_optimization' END AS task_type FROM orders)"
CHANGES = "changes AS (SELECT o_orderkey AS run_id, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE ['queued', 'running', 'completed', 'failed', 'cancelled'][o_custkey % 5 + 1] END AS status FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT -1, 'failed')"
ARTIFACTS = "artifacts AS (SELECT DISTINCT l_orderkey AS run_id, CASE WHEN l_linenumber % 2 = 0 THEN 'pmtiles' ELSE 'canonical_result' END AS type, CASE WHEN l_orderkey % 7 = 0 THEN 'building' WHEN l_orderkey % 11 = 0 THEN 'pending' ELSE 'ready' END AS status FROM lineitem)"
ALLOWED = " OR ".join(f"was = '{a}' AND status IN ({', '.join(map(repr, b))})" for a, b in metadata.TRANSITIONS.items())
ALLOWED_ARTIFACT = " OR ".join(f"was = '{a}' AND status IN ({', '.join(map(repr, b))})" for a, b in metadata.ARTIFACT_TRANSITIONS.items())


def named(k, names) -> F:
    return F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))


RUN_STATES = tuple(metadata.TRANSITIONS)


def runs(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select(k.alias("run_id"), named(k % 5, RUN_STATES).alias("status"), F.when(k % 4 == 0, "preparation").otherwise("discrete_optimization").alias("task_type"))


def artifacts(spark, d) -> DataFrame:
    k = F.col("l_orderkey")
    kind = F.when(F.col("l_linenumber") % 2 == 0, "pmtiles").otherwise("canonical_result")
    return read(spark, d, "lineitem").select(k.alias("run_id"), kind.alias("type"), F.when(k % 7 == 0, "building").when(k % 11 == 0, "pending").otherwise("ready").alias("status")).distinct()


@query(
    f"WITH {RUNS}, {CHANGES}, {ARTIFACTS}, ready AS (SELECT run_id, count(DISTINCT type) AS ready FROM artifacts WHERE status = 'ready' GROUP BY 1), sol AS (SELECT l_orderkey AS run_id, count(*) AS n, count(*) FILTER (l_linenumber = 1) AS r FROM lineitem WHERE l_linenumber < 3 GROUP BY 1), "
    f"j AS (SELECT c.run_id, r.status AS was, c.status, task_type, coalesce(ready, 0) AS ready, coalesce(n = 1 AND sol.r = 1, false) AS single FROM changes c LEFT JOIN runs r USING (run_id) LEFT JOIN ready USING (run_id) LEFT JOIN sol USING (run_id)) "
    f"SELECT run_id, was, status, CASE WHEN was IS NULL THEN 'unknown run' WHEN status IS NOT NULL AND NOT ({ALLOWED}) THEN 'invalid transition' WHEN status = 'completed' AND ready < 2 THEN 'artifacts not ready' WHEN status = 'completed' AND task_type = 'discrete_optimization' AND NOT single THEN 'no single reference solution' END AS problem FROM j"
)
def run_state_changes(spark, d):
    o = read(spark, d, "orders")
    changes = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_custkey") % 9 != 0, named(F.col("o_custkey") % 5, RUN_STATES)).alias("status"))
    changes = changes.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("run_id"), F.lit("failed").alias("status")))
    solutions = read(spark, d, "lineitem").where("l_linenumber < 3").select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_linenumber") == 1, "reference").otherwise("other").alias("role"))
    return states.run_changes(runs(spark, d), changes, artifacts(spark, d), solutions)


@query(
    f"WITH {ARTIFACTS}, c AS (SELECT run_id, type, ['pending', 'building', 'ready', 'failed'][run_id % 4 + 1] AS status, run_id % 5 = 0 AS bare FROM artifacts WHERE run_id % 2 = 0 UNION ALL SELECT -1, 'pmtiles', 'ready', true) "
    f"SELECT run_id, type, was, status, CASE WHEN was IS NULL THEN 'unknown artifact' WHEN NOT ({ALLOWED_ARTIFACT}) THEN 'invalid transition' WHEN status = 'ready' AND bare THEN 'incomplete' END AS problem FROM (SELECT c.*, a.status AS was FROM c LEFT JOIN artifacts a USING (run_id, type))"
)
def artifact_state_changes(spark, d):
    a = artifacts(spark, d)
    mark = lambda c: F.when(F.col("run_id") % 5 != 0, F.lit("x")).alias(c)
    c = a.where("run_id % 2 = 0").select("run_id", "type", named(F.col("run_id") % 4, tuple(metadata.ARTIFACT_TRANSITIONS)).alias("status"), mark("uri"), mark("checksum"), mark("manifest"))
    no = F.lit(None).cast("string")
    c = c.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("run_id"), F.lit("pmtiles").alias("type"), F.lit("ready").alias("status"), no.alias("uri"), no.alias("checksum"), no.alias("manifest")))
    return states.artifact_changes(a, c)


@query(f"WITH {ARTIFACTS} SELECT * FROM artifacts WHERE type = 'pmtiles' AND status <> 'ready'")
def unpublished_artifacts(spark, d):
    return states.unpublished(artifacts(spark, d))


@query("SELECT tile_id, coalesce(t, s) AS status, CASE WHEN t = 'COMPLETED' THEN 'u' END AS uri, CASE WHEN t = 'STARTED' THEN 7 END AS started_at, CASE WHEN t = 'COMPLETED' THEN 7 END AS completed_at, CASE WHEN t = 'FAILED' THEN 7 END AS failed_at FROM (SELECT o_orderkey AS tile_id, 'DRAFT' AS s, CASE WHEN o_custkey % 4 = 1 THEN 'STARTED' WHEN o_custkey % 4 = 2 AND o_custkey % 3 <> 0 THEN 'COMPLETED' WHEN o_custkey % 4 = 3 THEN 'FAILED' END AS t FROM orders)")
def tile_state_changes(spark, d):
    o, none = read(spark, d, "orders"), F.lit(None).cast("int")
    tiles = o.select(F.col("o_orderkey").alias("tile_id"), F.lit("DRAFT").alias("status"), F.lit(None).cast("string").alias("uri"), none.alias("started_at"), none.alias("completed_at"), none.alias("failed_at"))
    k = F.col("o_custkey")
    changes = o.where(k % 4 > 0).select(F.col("o_orderkey").alias("tile_id"), named(k % 4 - 1, ("started", "completed", "failed")).alias("status"), F.when(k % 3 != 0, F.lit("u")).alias("uri"))
    return states.tile_changes(tiles, changes, F.lit(7))


@query("SELECT * FROM (SELECT o_custkey AS task_id, o_orderkey AS tile_id, o_orderdate AS created_at, ['DRAFT', 'STARTED', 'COMPLETED', 'FAILED'][o_orderkey % 4 + 1] AS status FROM orders) QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY created_at DESC, tile_id DESC) = 1 AND status IN ('DRAFT', 'STARTED')")
def reusable_tiles(spark, d):
    k = F.col("o_orderkey")
    tiles = read(spark, d, "orders").select(F.col("o_custkey").alias("task_id"), k.alias("tile_id"), F.col("o_orderdate").alias("created_at"), named(k % 4, ("DRAFT", "STARTED", "COMPLETED", "FAILED")).alias("status"))
    return states.reusable_tiles(tiles)


@query(
    """WITH req AS (SELECT o_orderkey AS id, o_custkey AS p, CASE WHEN o_orderkey % 2 = 0 THEN 'and' ELSE 'or' END AS mode FROM orders),
rule AS (SELECT o_orderkey AS id, 'task' AS kind, o_orderkey % 40 AS obj, CASE WHEN o_orderkey % 3 = 0 THEN [] ELSE ['TASK_ADMIN'] END AS roles FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, 'profile', NULL, CASE WHEN o_orderkey % 4 = 0 THEN [] ELSE ['admin'] END FROM orders WHERE o_orderkey % 7 <> 0),
held AS (SELECT 'task' AS kind, c_custkey % 40 AS obj, c_custkey AS p, CASE WHEN c_custkey % 2 = 0 THEN 'task_admin' ELSE 'task_user' END AS role FROM customer UNION ALL SELECT 'profile', NULL, c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'admin' ELSE 'member' END FROM customer),
passed AS (SELECT rule.id, rule.kind, bool_or(role IS NOT NULL AND (rule.kind = 'task' AND len(roles) = 0 OR list_contains(list_transform(CASE WHEN rule.kind = 'profile' AND len(roles) = 0 THEN ['member'] ELSE roles END, lambda r: lower(r)), lower(role)))) AS ok
  FROM rule JOIN req USING (id) LEFT JOIN held ON held.kind = rule.kind AND held.p = req.p AND (rule.kind = 'profile' OR held.obj = rule.obj) GROUP BY 1, 2)
SELECT id AS request_id, CASE mode WHEN 'and' THEN coalesce(bool_and(ok), true) ELSE coalesce(bool_or(ok), false) END AS allowed FROM req LEFT JOIN passed USING (id) GROUP BY id, mode"""
)
def authorization(spark, d):
    o, c, k = read(spark, d, "orders"), read(spark, d, "customer"), F.col("o_orderkey")
    requests = o.select(k.alias("request_id"), F.col("o_custkey").alias("profile_id"), F.when(k % 2 == 0, "and").otherwise("or").alias("mode"))
    roles = lambda empty, role: F.when(empty, F.array().cast("array<string>")).otherwise(F.array(F.lit(role))).alias("roles")
    rules = o.where(k % 5 != 0).select(k.alias("request_id"), F.lit("task").alias("kind"), (k % 40).alias("object_id"), roles(k % 3 == 0, "TASK_ADMIN"))
    rules = rules.unionByName(o.where(k % 7 != 0).select(k.alias("request_id"), F.lit("profile").alias("kind"), F.lit(None).cast("long").alias("object_id"), roles(k % 4 == 0, "admin")))
    p = F.col("c_custkey")
    granted = c.select(F.lit("task").alias("kind"), (p % 40).alias("object_id"), p.alias("profile_id"), F.when(p % 2 == 0, "task_admin").otherwise("task_user").alias("role"))
    return states.authorized(requests, rules, granted, c.select(p.alias("profile_id"), F.when(p % 6 == 0, "admin").otherwise("member").alias("role")))


@query(
    "WITH a AS (SELECT o_orderkey % 200 AS d, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey END AS p FROM orders), x AS (SELECT c_custkey AS d, ['NOBODY', 'MEMBERS_ONLY', 'ANYONE_WITH_LINK'][c_custkey % 3 + 1] AS access FROM customer WHERE c_custkey < 150), m AS (SELECT DISTINCT o_orderkey % 200 AS d, o_custkey AS p FROM orders WHERE o_custkey % 2 = 0) "
    "SELECT a.d AS dashboard_id, a.p AS profile_id, CASE WHEN access IS NULL THEN 'not found' WHEN access = 'NOBODY' OR access = 'MEMBERS_ONLY' AND m.d IS NULL THEN CASE WHEN a.p IS NULL THEN 'not found' ELSE 'denied' END ELSE 'shown' END AS answer FROM a LEFT JOIN x USING (d) LEFT JOIN m ON m.d = a.d AND m.p = a.p"
)
def dashboard_visibility(spark, d):
    o, k = read(spark, d, "orders"), F.col("c_custkey")
    asked = o.select((F.col("o_orderkey") % 200).alias("dashboard_id"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("profile_id"))
    dashboards = read(spark, d, "customer").where("c_custkey < 150").select(k.alias("dashboard_id"), named(k % 3, ("NOBODY", "MEMBERS_ONLY", "ANYONE_WITH_LINK")).alias("access"))
    members = o.where("o_custkey % 2 = 0").select((F.col("o_orderkey") % 200).alias("dashboard_id"), F.col("o_custkey").alias("profile_id"))
    return states.visible(dashboards, asked, members)


@query(
    "WITH i AS (SELECT DISTINCT o_orderkey % 50 AS object_id, lower('U' || o_custkey * 2 || '@x') AS email FROM orders), p AS (SELECT lower('u' || c_custkey || '@X') AS email, min(c_custkey) AS profile_id FROM customer GROUP BY 1), e AS (SELECT DISTINCT o_orderkey % 50 AS object_id, o_custkey AS profile_id FROM orders WHERE o_orderkey % 3 = 0) "
    "SELECT i.object_id, i.email, p.profile_id, CASE WHEN p.profile_id IS NULL THEN 'skipped' WHEN e.profile_id IS NOT NULL THEN 'existing' ELSE 'added' END AS outcome FROM i LEFT JOIN p USING (email) LEFT JOIN e ON e.object_id = i.object_id AND e.profile_id = p.profile_id"
)
def invite_resolution(spark, d):
    o = read(spark, d, "orders")
    mail = lambda k, end: F.concat(F.lit(" U"), k.cast("string"), F.lit(end)).alias("email")
    object_id = (F.col("o_orderkey") % 50).alias("object_id")
    profiles = read(spark, d, "customer").select(F.col("c_custkey").alias("profile_id"), mail(F.col("c_custkey"), "@X "))
    return states.invited(o.select(object_id, mail(F.col("o_custkey") * 2, "@x")), profiles, o.where("o_orderkey % 3 = 0").select(object_id, F.col("o_custkey").alias("profile_id")))


@query("SELECT upper(c_name) AS guid, CASE WHEN c_custkey % 4 = 0 THEN 'other' ELSE c_mktsegment END AS agency, CASE WHEN c_custkey % 5 = 0 THEN 'member' ELSE 'admin' END AS role, CASE WHEN c_custkey % 5 = 0 THEN 'insert' WHEN c_custkey % 4 = 0 THEN 'update' ELSE 'none' END AS operation FROM customer")
def profile_upsert(spark, d):
    c = read(spark, d, "customer").withColumn("c_name", F.upper("c_name"))
    old = c.where("c_custkey % 5 <> 0").select(F.col("c_name").alias("guid"), F.col("c_mktsegment").alias("agency"), F.lit("admin").alias("role"))
    new = c.select(F.col("c_name").alias("guid"), F.when(F.col("c_custkey") % 4 == 0, "other").otherwise(F.col("c_mktsegment")).alias("agency"))
    return states.upserted(old, new, ["agency"])


@query("SELECT n_nationkey, n_nationkey = 7 AS is_default FROM nation")
def default_promotion(spark, d):
    return states.promoted(read(spark, d, "nation").select("n_nationkey"), "n_nationkey", F.lit(7))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)")
def hard_delete(spark, d):
    gone = read(spark, d, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return states.deleted(read(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey"]).select("o_orderkey")


@query("SELECT o_orderkey AS run_id, 1 + coalesce(n, 0) AS revision FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey")
def revision_touch(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.lit(1).cast("long").alias("revision"))
    return states.touched(rows, read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("run_id")))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 9 END AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE -1 END AS created_by, CASE WHEN o_orderkey % 3 = 0 THEN 9 END AS updated_at, CASE WHEN o_orderkey % 3 = 0 THEN -1 END AS updated_by FROM orders")
def journal_stamps(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    before = o.where("k % 3 = 0").select("k", F.lit(1).alias("created_at"), F.col("o_custkey").alias("created_by"))
    return states.stamped(before, o.select("k"), "k", F.lit(-1).cast("long"), F.lit(9))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 6 = 0 AND o_orderpriority IS DISTINCT FROM CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE '1-URGENT' END")
def immutability_violations(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    changed = F.when(F.col("o_orderkey") % 6 == 0, F.when(F.col("o_custkey") % 2 != 0, F.lit("1-URGENT"))).otherwise(F.col("o_orderpriority"))
    return states.mutated(o, o.withColumn("o_orderpriority", changed), "o_orderkey", ["o_orderpriority"])


@query("SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark, d):
    return states.repeated(read(spark, d, "orders"), ["o_custkey", "o_orderpriority"], F.col("o_orderstatus") == "F")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20)")
def foreign_key_violations(spark, d):
    return states.dangling(read(spark, d, "lineitem"), read(spark, d, "supplier").where("s_nationkey < 20"), "l_suppkey", "s_suppkey").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' END AS status FROM orders")
def enum_rename(spark, d):
    return states.renamed(read(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), "status", {"F": "failed", "O": "queued", "P": "running"}, RUN_STATES)


@query("SELECT event_id FROM events WHERE event_type NOT IN ('view', 'click')")
def enum_violations(spark, d):
    return states.unlike(read(spark, d, "events"), "event_type", ("view", "click")).select("event_id")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def latest_of_key(spark, d):
    return states.latest_of(read(spark, d, "orders"), "o_custkey", "o_orderkey", ["o_orderdate", "o_orderkey"])


@query("SELECT n_nationkey AS project_id, n_regionkey AS profile_id, 'project_admin' AS role FROM nation")
def project_creation(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("colour"), F.col("n_regionkey").alias("creator"))
    return states.created(n, scalars.seed_colour(F.col("name")))[2]


@query("SELECT c_custkey FROM customer JOIN (SELECT DISTINCT lower(c_mktsegment) AS s FROM customer WHERE c_custkey % 100 = 3) ON lower(c_mktsegment) = s")
def equal_without_case(spark, d):
    c = read(spark, d, "customer")
    some = c.where("c_custkey % 100 = 3").select(F.lower("c_mktsegment").alias("s")).distinct()
    return c.join(some, states.equal_names(F.upper("c_mktsegment"), F.col("s"))).select("c_custkey")


# --- scalars ---------------------------------------------------------------------------------------------------------
@query(
    "WITH t AS (SELECT c_custkey, c_custkey % 70 AS z, ['', 'n', 'K', 'I'][c_custkey % 4 + 1] AS l, (100000 + c_custkey * 997)::BIGINT AS e, (c_custkey * 7919)::BIGINT AS n FROM customer), u AS (SELECT *, CASE WHEN l = '' OR l = 'n' THEN n <= 9334080 ELSE n BETWEEN 1110400 AND 10000000 END AS fits FROM t) "
    "SELECT c_custkey, CASE WHEN l <> 'I' AND z BETWEEN 1 AND 60 AND e BETWEEN 166640 AND 833360 AND fits THEN z + CASE WHEN l = 'K' THEN 32700 ELSE 32600 END END::INT AS srid FROM u"
)
def utm_parse(spark, d):
    k = F.col("c_custkey")
    text = F.concat_ws(" ", F.concat((k % 70).cast("string"), named(k % 4, ("", "n", "K", "I"))), (100000 + k * 997).cast("string"), (k * 7919).cast("string"))
    return read(spark, d, "customer").select("c_custkey", scalars.utm(text)["srid"].alias("srid"))


@query("WITH t AS (SELECT c_custkey, c_custkey * 7919 % 21000 - 10500 AS u, c_custkey * 104729 % 40000 - 20000 AS v FROM customer) SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 AND abs(u) <= 9000 AND abs(v) <= 18000 THEN u / 100.0::DOUBLE + v / 100.0::DOUBLE END AS point FROM t")
def lat_long_parse(spark, d):
    k = F.col("c_custkey")
    shown = lambda n: F.concat(F.when(n < 0, "-").otherwise(""), F.floor(F.abs(n) / 100).cast("string"), F.lit("."), F.lpad((F.abs(n) % 100).cast("string"), 2, "0"))
    text = F.concat(shown(k * 7919 % 21000 - 10500), F.when(k % 3 < 2, " ").otherwise("x"), shown(k * 104729 % 40000 - 20000))
    p = scalars.lat_long(text)
    return read(spark, d, "customer").select("c_custkey", (p["lat"] + p["long"]).alias("point"))


@query(
    """WITH RECURSIVE h AS (SELECT n_nationkey AS k, n_name AS s, 1 AS i, 0::BIGINT AS h FROM nation UNION ALL SELECT k, s, i + 1, (((h * 31 + unicode(substr(s, i, 1))) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 FROM h WHERE i <= length(s)),
f AS (SELECT k, h + CASE WHEN h < 0 THEN 4294967296 ELSE 0 END AS h FROM h WHERE i = length(s) + 1)
SELECT k AS n_nationkey, '#' || lpad(lower(to_hex(90 + (h & 255) % 101)), 2, '0') || lpad(lower(to_hex(90 + ((h >> 8) & 255) % 101)), 2, '0') || lpad(lower(to_hex(110 + ((h >> 16) & 255) % 101)), 2, '0') AS colour FROM f"""
)
def seed_colours(spark, d):
    return read(spark, d, "nation").select("n_nationkey", scalars.seed_colour(F.col("n_name")).alias("colour"))


@query(
    "WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '1' ELSE '' END || (2000000000 + o_orderkey * 7)::VARCHAR AS n, o_orderkey % 5 AS m FROM orders), c AS (SELECT *, CASE m WHEN 0 THEN left(n, 5) WHEN 1 THEN n || '99' ELSE n END AS g FROM t), x AS (SELECT *, CASE WHEN g LIKE '1%' THEN substr(g, 2) ELSE g END AS l FROM c) "
    "SELECT o_orderkey, CASE WHEN length(l) > 10 OR length(g) <= 1 THEN g ELSE trim(CASE WHEN g LIKE '1%' THEN '+1' ELSE '' END || ' (' || substr(l, 1, 3) || ') ' || array_to_string(list_filter([substr(l, 4, 3), substr(l, 7)], lambda v: v <> ''), '-')) END AS phone FROM x"
)
def phone_format(spark, d):
    k = F.col("o_orderkey")
    n = F.concat(F.when(k % 3 == 0, "1").otherwise(""), (2000000000 + k * 7).cast("string"))
    text = F.when(k % 5 == 0, F.substring(n, 1, 5)).when(k % 5 == 1, F.concat(n, F.lit("99"))).otherwise(n)
    return read(spark, d, "orders").select("o_orderkey", scalars.phone(F.regexp_replace(text, "(..)", "$1-")).alias("phone"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE format('{:,}', floor(o_totalprice)::BIGINT) || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '.25' END END AS budget FROM orders")
def budget_format(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 10 == 0, "$ -").otherwise(F.concat(F.lit("$ "), F.floor("o_totalprice").cast("string"), F.when(k % 2 == 0, "").otherwise(".259")))
    return read(spark, d, "orders").select("o_orderkey", scalars.budget(text).alias("budget"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE '#' || upper(lpad(to_hex(c_custkey), 6, '0')) END AS colour, CASE WHEN c_custkey % 3 = 0 THEN 'running' END AS status, CASE WHEN c_custkey % 3 = 0 THEN 'Running' ELSE 'Odd' END AS label FROM customer")
def colours_and_statuses(spark, d):
    k = F.col("c_custkey")
    colour = F.when(k % 4 == 0, "  ").otherwise(F.concat(F.when(k % 2 == 0, " #").otherwise(""), F.lower(F.lpad(F.hex(k), 6, "0"))))
    status = F.when(k % 3 == 0, "RUNNING").otherwise("Odd")
    return read(spark, d, "customer").select("c_custkey", scalars.hex_colour(colour).alias("colour"), scalars.status(status).alias("status"), scalars.status_label(F.when(k % 3 == 0, F.lower(status)).otherwise(status)).alias("label"))


@query("SELECT c_custkey, ['pmtiles://a/' || c_custkey, 'pmtiles://https://h/' || c_custkey, 'pmtiles://store/k/' || c_custkey, NULL, NULL][c_custkey % 5 + 1] AS url, ['pmtiles:/a/' || c_custkey, c_custkey::VARCHAR, 'k/' || c_custkey, 'only', ''][c_custkey % 5 + 1] AS path FROM customer".replace("'pmtiles:/a/' || c_custkey", "'pmtiles://a/' || c_custkey"))
def tile_urls(spark, d):
    k = F.col("c_custkey")
    n = k.cast("string")
    uri = F.element_at(F.array(F.concat(F.lit("pmtiles://a/"), n), F.concat(F.lit("https://h/"), n), F.concat(F.lit("s3://b/k/"), n), F.lit("only"), F.lit("s3://b/")), (k % 5 + 1).cast("int"))
    return read(spark, d, "customer").select("c_custkey", scalars.tile_url(uri, "store").alias("url"), scalars.array_path(uri).alias("path"))


@query("SELECT c_custkey, [c_custkey, c_custkey * 1000, NULL, NULL][c_custkey % 4 + 1] AS setting FROM customer")
def integer_settings(spark, d):
    k, n = F.col("c_custkey"), F.col("c_custkey").cast("string")
    text = F.element_at(F.array(F.concat(F.lit(" "), n, F.lit(".0 ")), F.concat(n, F.lit("e3")), F.concat(n, F.lit(".5")), F.lit("many")), (k % 4 + 1).cast("int"))
    return read(spark, d, "customer").select("c_custkey", scalars.integer_setting(text).alias("setting"))


@query("SELECT p_partkey, round_even(13 - (ln(least(greatest(p_partkey * 3.0, 30), 5000)) - ln(30)) / (ln(5000) - ln(30)) * 6, 0)::INT AS zoom, least(greatest(floor((lon + 180) / 360 * 256), 0), 255)::BIGINT AS x, least(greatest(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 256), 0), 255)::BIGINT AS y FROM (SELECT p_partkey, (p_partkey * 7 % 360 - 180 + 0.3)::DOUBLE AS lon, (p_partkey * 11 % 170 - 85 + 0.4)::DOUBLE AS lat FROM part)")
def zoom_and_tiles(spark, d):
    k = F.col("p_partkey")
    x, y = scalars.tile_xy((k * 7 % 360 - 180 + 0.3).cast("double"), (k * 11 % 170 - 85 + 0.4).cast("double"), 8)
    return read(spark, d, "part").select("p_partkey", scalars.max_zoom(k * 3.0).alias("zoom"), x.alias("x"), y.alias("y"))


@query(
    "WITH t AS (SELECT p_partkey, [30.0, 60, 120, 480][p_partkey % 4 + 1]::DOUBLE AS native, 120.0 AS target, CASE WHEN p_partkey % 3 = 0 THEN 0.5 ELSE 2 END AS r, p_partkey % 7 <> 0 AS same, ['nearest_constant', 'overlap_constant', 'prohibit', NULL][p_size % 4 + 1] AS policy FROM part), a AS (SELECT *, p_partkey % 3 <> 0 AND target >= native AS aligned FROM t) "
    "SELECT p_partkey, CASE WHEN NOT same THEN 'bounded_reproject' WHEN aligned AND native = target THEN 'direct' WHEN aligned AND native < target THEN 'nested_aggregate' WHEN native > target THEN CASE WHEN policy IN ('nearest_constant', 'overlap_constant') THEN 'coarse_to_fine_' || policy ELSE 'prohibited' END ELSE 'bounded_reproject' END AS mapping FROM a"
)
def layer_mapping_runtime(spark, d):
    k = F.col("p_partkey")
    native = F.element_at(F.array(*map(F.lit, (30.0, 60.0, 120.0, 480.0))), (k % 4 + 1).cast("int"))
    policy = F.element_at(F.array(F.lit("nearest_constant"), F.lit("overlap_constant"), F.lit("prohibit"), F.lit(None).cast("string")), (F.col("p_size") % 4 + 1).cast("int"))
    place = F.when(k % 3 == 0, 0.5).otherwise(2.0)
    return read(spark, d, "part").select("p_partkey", scalars.runtime_mapping(native, F.lit(120.0), place, F.lit(2.0), k % 7 != 0, policy).alias("mapping"))


@query("""SELECT c_custkey, md5(c_custkey || ':legacy') || md5(c_custkey || ':legacy:2') AS hash, CASE WHEN c_custkey % 3 > 0 THEN c_custkey END AS setting, greatest(5242880, ceil(c_custkey * 100000000 / 10000.0))::BIGINT AS part, [1800, 7200, 86400, NULL][c_custkey % 4 + 1] AS seconds FROM customer""")
def scalar_settings(spark, d):
    k = F.col("c_custkey")
    seconds, _ = scalars.mode_budget(named(k % 4, ("interactive", "balanced", "exact_audit", "other")))
    return read(spark, d, "customer").select("c_custkey", scalars.legacy_hash(k).alias("hash"), scalars.blank_to_null(F.when(k % 3 > 0, k.cast("string")).otherwise(""), "long").alias("setting"), scalars.part_size(k * 100_000_000).alias("part"), seconds.alias("seconds"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, event_type AS kind, 'BIGINT' AS type, user_id AS of, NULL::VARCHAR AS none FROM events")
def json_set(spark, d):
    props = scalars.with_entry(scalars.with_entry(F.col("props"), "kind", F.lit("old")), "kind", F.col("event_type"))
    props = scalars.with_entry(scalars.with_entry(props, "user", F.parse_json(F.lit('{"id": 0}'))), ("user", "id"), F.col("user_id"))
    rows = read(spark, d, "events").withColumn("props", F.parse_json(scalars.with_entry(props, ("nobody", "id"), F.lit(1))))
    of = lambda path, kind: F.variant_get("props", path, kind)
    return rows.select("event_id", of("$.k", "long").alias("k"), of("$.kind", "string").alias("kind"), F.schema_of_variant(of("$.k", "variant")).alias("type"), of("$.user.id", "long").alias("of"), of("$.nobody", "string").alias("none"))


#: Models of suppliers' nations: parts as units, suppliers as rows, their lines as nonzeros; some only counted so far.
MODELS = "m AS (SELECT s_nationkey AS model, count(DISTINCT l_partkey) AS units, count(DISTINCT l_suppkey) AS rws, count(*) AS nnz FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1), a AS (SELECT *, model % 5 = 0 AS early, 2 * units AS aux FROM m)"


@query(
    f"""WITH {MODELS}, b AS (SELECT *, CASE WHEN early THEN 0 ELSE rws END AS r, CASE WHEN early THEN 0 ELSE nnz END AS z FROM a),
c AS (SELECT *, 25 * (units + aux) + 8 * (r + 1) + 12 * z + 16 * r AS compiler, 37 * (units + aux) + 8 * (r + 1) + 12 * z + 16 * r AS solver FROM b)
SELECT model, compiler AS compiler_bytes, solver AS solver_bytes, 12 * nnz + compiler AS scratch_bytes, floor(1.5 * (compiler + solver))::BIGINT AS peak_bytes, CASE WHEN early THEN 'structural_inventory' ELSE 'compiled_model' END AS gate,
CASE WHEN early THEN 'structural_inventory_required' WHEN floor(1.5 * (compiler + solver)) > 60000 THEN 'profile_peak_memory_exceeded' WHEN 12 * nnz + compiler > 27000 THEN 'profile_scratch_space_exceeded' ELSE 'admitted' END AS reason FROM c"""
)
def model_admissions(spark, d):
    rows = read(spark, d, "lineitem").join(read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("model"))
    rows = rows.agg(F.countDistinct("l_partkey").alias("planning_units"), F.countDistinct("l_suppkey").alias("rows"), F.count("*").alias("feature_nonzeros"))
    early = F.col("model") % 5 == 0
    models = rows.withColumns({"primary": F.lit(None).cast("long"), "auxiliary": 2 * F.col("planning_units"), "rows": F.when(~early, F.col("rows")), "nonzeros": F.when(~early, F.col("feature_nonzeros"))})
    return contracts.admissions(models, 60_000, 27_000).select("model", "compiler_bytes", "solver_bytes", "scratch_bytes", "peak_bytes", "gate", "reason")


#: Contracts of parts: kinds, statistics and quantities in turn, some of them missing or unknown.
@query(
    """WITH c AS (SELECT p_partkey AS layer, ['amount', 'density', 'probability', 'binary', 'categorical', 'cost', 'odd'][p_partkey % 7 + 1] AS kind, ['sum', 'mode', 'median', NULL, 'any'][p_size % 5 + 1] AS statistic, ['extensive', 'intensive', 'categorical', 'amount', NULL][p_partkey // 7 % 5 + 1] AS quantity, CASE WHEN p_size % 2 = 0 THEN 'lowest_value' END AS tie_rule FROM part),
a AS (SELECT *, CASE kind WHEN 'amount' THEN statistic IN ('sum', 'median') WHEN 'cost' THEN statistic IN ('sum', 'median') WHEN 'density' THEN statistic = 'median' WHEN 'probability' THEN statistic = 'median' WHEN 'binary' THEN statistic IN ('any', 'mode') WHEN 'categorical' THEN statistic = 'mode' END AS fits FROM c)
SELECT layer, 'unknown kind' AS problem FROM a WHERE kind = 'odd' UNION ALL SELECT layer, 'statistic not admitted' FROM a WHERE kind <> 'odd' AND coalesce(fits, false) = false
UNION ALL SELECT layer, 'unknown quantity' FROM a WHERE coalesce(quantity, '') NOT IN ('extensive', 'intensive', 'categorical')
UNION ALL SELECT layer, 'mode needs a categorical quantity' FROM a WHERE statistic = 'mode' AND quantity IS DISTINCT FROM 'categorical'
UNION ALL SELECT layer, 'mode needs the lowest value on ties' FROM a WHERE statistic = 'mode' AND tie_rule IS NULL
UNION ALL SELECT layer, 'sum needs an extensive quantity' FROM a WHERE statistic = 'sum' AND quantity IS DISTINCT FROM 'extensive'"""
)
def contract_violations(spark, d):
    k = F.col("p_partkey")
    of = lambda i, *names: F.element_at(F.array(*(F.lit(n).cast("string") for n in names)), (i + 1).cast("int"))
    rows = read(spark, d, "part").select(
        k.alias("layer"), of(k % 7, "amount", "density", "probability", "binary", "categorical", "cost", "odd").alias("kind"), of(F.col("p_size") % 5, "sum", "mode", "median", None, "any").alias("statistic"),
        of(F.floor(k / 7) % 5, "extensive", "intensive", "categorical", "amount", None).alias("quantity"), F.when(F.col("p_size") % 2 == 0, "lowest_value").alias("tie_rule"))
    return contracts.violations(spark, rows)


@query(f"WITH {EDGES}, e AS (SELECT a AS unit, sb AS s FROM edges UNION ALL SELECT b, sa FROM edges) SELECT unit, count(*) FILTER (s = -1) AS flexible, count(*) FILTER (s = 1) AS selected, count(*) AS degree FROM e GROUP BY 1")
def neighbour_counts(spark, d):
    s = unit_states(spark, d)
    return graph.neighbour_counts(graph.rook_edges(s), s.select("unit", "state"))


@query("SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%ring%' AND list_contains(string_split(lower(p_type || '/' || p_brand), '/'), 'economy')")
def layer_group_filter(spark, d):
    group = F.concat_ws("/", "p_type", "p_brand")
    return read(spark, d, "part").where(scalars.group_matches(F.col("p_name"), group, " Ring ", ("economy",))).select("p_partkey")


@query("SELECT o_custkey, array_to_string(list_sort(list_distinct(list(lower(trim(o_orderpriority))))), ',') AS names FROM orders GROUP BY 1")
def distinct_names(spark, d):
    rows = read(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.concat(F.lit(" "), "o_orderpriority")).alias("x"))
    return rows.select("o_custkey", F.array_join(F.array_sort(scalars.emails("x")), ",").alias("names"))


# --- geometry, masks, pyramids ---------------------------------------------------------------------------------------
@query(f"WITH {CELLS} SELECT unit FROM cells WHERE (row + 0.5 BETWEEN 3 AND 12 AND col + 0.5 BETWEEN 5 AND 40 AND NOT (row + 0.5 > 6 AND row + 0.5 < 9 AND col + 0.5 > 10 AND col + 0.5 < 20)) OR (row + 0.5 BETWEEN 15 AND 18 AND col + 0.5 BETWEEN 0 AND 30)")
def area_of_interest(spark, d):
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    parts = [[box(5, 3, 40, 12), box(10, 6, 20, 9)], [box(0, 15, 30, 18)]]
    return cells(spark, d).where(geo.in_area(F.col("col") + 0.5, F.col("row") + 0.5, geo.polygons(parts))).select("unit")


@query("SELECT c_nationkey, min(c_custkey % 60) AS x0, min(c_custkey % 50) AS y0, max(c_custkey % 60) + 2 AS x1, max(c_custkey % 50) + 1 AS y1 FROM customer GROUP BY 1".replace("+ 2", "+ 2.0").replace("+ 1 AS", "+ 1.0 AS").replace("min(c_custkey % 60)", "min(c_custkey % 60)::DOUBLE").replace("min(c_custkey % 50)", "min(c_custkey % 50)::DOUBLE").replace("max(c_custkey % 60) + 2.0", "max(c_custkey % 60)::DOUBLE + 2").replace("max(c_custkey % 50) + 1.0", "max(c_custkey % 50)::DOUBLE + 1"))
def geometry_bounds(spark, d):
    x, y = (F.col("c_custkey") % 60).cast("double"), (F.col("c_custkey") % 50).cast("double")
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    rows = read(spark, d, "customer").withColumn("ring", F.array(point(x, y), point(x + 2, y), point(x + 2, y + 1), point(x, y)))
    return geo.bounds(rows, ["c_nationkey"], "ring")


@query("SELECT c_custkey, round(abs(2 * radians(4.0) * (sin(radians(y + 4.0)) - sin(radians(y))) - 2 * radians(1.0) * (sin(radians(y + 2.0)) - sin(radians(y + 1.0)))) / 2 * 6371008.8 * 6371008.8 / 1e6, 3) AS area_km2 FROM (SELECT c_custkey, (c_custkey % 60)::DOUBLE AS y FROM customer)")
def spherical_area_with_holes(spark, d):
    y = (F.col("c_custkey") % 60).cast("double")
    point = lambda a, b: F.struct(F.lit(a).alias("x"), b.alias("y"))
    box = lambda x0, x1, low, high: F.array(point(x0, low), point(x1, low), point(x1, high), point(x0, high))
    area = geo.polygon_area(F.array(box(10.0, 14.0, y, y + 4), box(11.0, 12.0, y + 1, y + 2)))
    return read(spark, d, "customer").select("c_custkey", F.round(area / 1e6, 3).alias("area_km2"))


@query("SELECT p_partkey AS position FROM part WHERE p_size % 3 = 0")
def mask_round_trip(spark, d):
    rows = masks.pack(read(spark, d, "part").where("p_size % 3 = 0").select(F.col("p_partkey").cast("long").alias("position")), [])
    return rows.select("chunk", F.explode(masks.unpack("mask")).alias("place")).select((F.col("chunk") * masks.SPAN + F.col("place")).alias("position"))


PYRAMID = """d AS (SELECT o_orderkey // 100 AS row, o_orderkey % 100 AS col, CASE WHEN o_custkey % 5 = 0 THEN 255 WHEN o_custkey % 7 = 0 THEN 1 ELSE 0 END AS v FROM orders)"""


@query(
    f"WITH RECURSIVE {PYRAMID}, p AS (SELECT 0 AS level, row, col, v FROM d UNION ALL SELECT level + 1, row // 2, col // 2, CASE WHEN bool_or(v = 1) THEN 1 WHEN bool_or(v <> 255) THEN 0 ELSE 255 END FROM p WHERE level < (SELECT greatest(0, ceil(log2(greatest(max(row), max(col)) + 1) - 3))::INT FROM d) GROUP BY ALL) SELECT level, row, col, v AS value FROM p WHERE level > 0"
)
def pyramid_decision(spark, d):
    v = F.when(F.col("o_custkey") % 5 == 0, 255).when(F.col("o_custkey") % 7 == 0, 1).otherwise(0)
    rows = read(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 100).alias("row"), (F.col("o_orderkey") % 100).alias("col"), v.alias("value"))
    return resample.overviews(rows, "decision", 8, save)


# --- change events ---------------------------------------------------------------------------------------------------
@query("SELECT event_id FROM (SELECT *, lag(event_type) OVER w AS t, lag(round(value)) OVER w AS v, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR t IS DISTINCT FROM event_type OR v IS DISTINCT FROM round(value)")
def changed_events(spark, d):
    rows = read(spark, d, "events").withColumn("value", F.round("value"))
    return changes.changed_only(rows, "user_id", ["event_type", "value"], ["ts", "event_id"]).select("event_id")


@query("SELECT ['task', 'scope', 'ignored', 'invalid', 'invalid'][event_id % 5 + 1] AS kind, count(*) AS n FROM events GROUP BY 1")
def event_dispatch(spark, d):
    k, n = F.col("event_id"), F.col("event_id").cast("string")
    text = lambda **x: F.to_json(F.struct(*(F.lit(v).alias(c) if isinstance(v, str) else v.alias(c) for c, v in x.items())))
    message = F.when(k % 5 == 0, text(type="task.updated", task_id=n, status="running")).when(k % 5 == 1, text(type="profile_scope.updated", profile_id=n))
    message = message.when(k % 5 == 2, text(type="task_run.updated")).when(k % 5 == 3, text(type="task.updated", task_id=n)).otherwise("{no json")
    return changes.dispatched(read(spark, d, "events").select(message.alias("message")), "message").groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS profile_id, o_orderkey::VARCHAR AS task_id, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 = 0")
def event_fan_out(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").cast("string").alias("task_id"), F.col("o_orderstatus").alias("status"))
    return changes.fan_out(o.where(F.col("task_id").cast("long") % 3 == 0), o.select("profile_id", "task_id"))


@query("SELECT c_custkey, polygon_no, ring_no, n FROM (SELECT c_custkey, unnest(CASE c_custkey % 4 WHEN 0 THEN [0] WHEN 1 THEN [0, 1] WHEN 2 THEN [0, 0] ELSE [] END) AS polygon_no, unnest(CASE c_custkey % 4 WHEN 0 THEN [0] WHEN 1 THEN [0, 0] WHEN 2 THEN [0, 1] ELSE [] END) AS ring_no, 4 AS n FROM customer)")
def geojson_rings(spark, d):
    ring = "[[0,0],[4,0],[4,4],[0,0]]"
    texts = (f'{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[{ring}]}}}}', f'{{"type":"MultiPolygon","coordinates":[[{ring}],[{ring}]]}}', f'{{"type":"FeatureCollection","features":[{{"geometry":{{"type":"Polygon","coordinates":[{ring},{ring}]}}}}]}}', '{"type":"Point","coordinates":[1,2]}')
    rows = read(spark, d, "customer").select("c_custkey", named(F.col("c_custkey") % 4, texts).alias("text"))
    return tables.rings(rows, "text").select("c_custkey", "polygon_no", "ring_no", F.size("ring").alias("n"))


# --- problems before they are compiled -------------------------------------------------------------------------------
@query(
    """WITH o AS (SELECT o_custkey AS problem_id, 'l' || (o_orderkey % 9) AS layer, CASE WHEN o_orderkey % 50 = 0 THEN 'up' ELSE 'maximize' END AS direction, CASE WHEN o_orderkey % 31 = 0 THEN -1.0 ELSE 1.0 END AS importance FROM orders),
c AS (SELECT c_custkey AS problem_id, 'l' || (c_custkey % 12) AS layer, CASE WHEN c_custkey % 3 > 0 THEN 5.0 END AS low, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 10 * 1.0 END AS high FROM customer),
k AS (SELECT c_custkey AS problem_id, unnest(['l0', 'l1', 'l2', 'l3', 'l4', 'l5', 'l6', 'l7']) AS layer FROM customer)
SELECT problem_id, layer, 'unknown direction' AS problem FROM o WHERE direction = 'up' UNION ALL SELECT problem_id, layer, 'negative importance' FROM o WHERE importance < 0
UNION ALL SELECT problem_id, layer, 'layer twice in objectives' FROM o GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT problem_id, layer, 'no bound' FROM c WHERE low IS NULL AND high IS NULL UNION ALL SELECT problem_id, layer, 'minimum above maximum' FROM c WHERE low > high
UNION ALL SELECT problem_id, layer, 'no contract' FROM (SELECT problem_id, layer FROM o UNION SELECT problem_id, layer FROM c) AS n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.problem_id = n.problem_id AND k.layer = n.layer)
UNION ALL SELECT c_custkey, NULL, 'no objective' FROM customer WHERE c_custkey NOT IN (SELECT problem_id FROM o)"""
)
def problem_violations(spark, d):
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    layer = lambda n: F.concat(F.lit("l"), n.cast("string")).alias("layer")
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("problem_id"), layer(k % 9), F.when(k % 50 == 0, "up").otherwise("maximize").alias("direction"), F.when(k % 31 == 0, -1.0).otherwise(1.0).alias("importance"))
    customers = read(spark, d, "customer")
    bounds = customers.select(c.alias("problem_id"), F.lit("aggregate").alias("type"), layer(c % 12), F.when(c % 3 > 0, 5.0).alias("low"), F.when(c % 4 > 0, (c % 10).cast("double")).alias("high"))
    contracts = customers.select(c.alias("problem_id"), F.explode(F.array(*(F.lit(f"l{i}") for i in range(8)))).alias("layer"))
    return problems.problem_violations(o, bounds, contracts)


def layer_contracts(spark, d) -> DataFrame:
    p, q = F.col("o_custkey"), F.col("o_orderkey")
    sizes = F.element_at(F.array(*map(F.lit, (30.0, 60.0, 500.0))), (q % 3 + 1).cast("int"))
    return read(spark, d, "orders").select(p.alias("problem_id"), sizes.alias("native"), (sizes * (q % 5 + 1)).alias("evidence"))


CONTRACTS = "k AS (SELECT o_custkey AS problem_id, [30.0, 60, 500][o_orderkey % 3 + 1]::DOUBLE AS native, [30.0, 60, 500][o_orderkey % 3 + 1]::DOUBLE * (o_orderkey % 5 + 1) AS evidence FROM orders)"


@query(f"WITH {CONTRACTS} SELECT problem_id, min(evidence) AS finest, max(evidence) AS coarsest FROM k GROUP BY 1")
def evidence_range(spark, d):
    return problems.evidence(layer_contracts(spark, d))


@query(
    f"WITH {CONTRACTS}, p AS (SELECT c_custkey AS problem_id, CASE WHEN c_custkey % 9 > 0 THEN c_acctbal * 1e6 + 1e10 END AS area, 120.0 AS target FROM customer), r AS (SELECT problem_id, area, coalesce(sum(greatest(1, (target / native) ** 2)), 0) AS read FROM p LEFT JOIN k USING (problem_id) GROUP BY 1, 2) "
    "SELECT problem_id, ceil(area / 120 / 120)::BIGINT AS units, ceil(ceil(area / 120 / 120) * read)::BIGINT AS source_cells, ceil(ceil(area / 120 / 120) * read * 4)::BIGINT AS input_bytes FROM r"
)
def size_estimates(spark, d):
    c = F.col("c_custkey")
    p = read(spark, d, "customer").select(c.alias("problem_id"), F.when(c % 9 > 0, F.col("c_acctbal") * 1e6 + 1e10).alias("area"), F.lit(120.0).alias("target"))
    return problems.estimates(p, layer_contracts(spark, d))


@query("SELECT c_custkey AS id, unnest(list_filter([CASE WHEN c_custkey % 7 = 0 THEN 'time limit not positive' END, CASE WHEN c_custkey % 11 = 0 THEN 'negative relative gap' END, CASE WHEN c_custkey % 13 = 0 THEN 'no threads' END, CASE WHEN c_custkey % 5 = 0 THEN 'reserved options: random_seed, threads' END], lambda x: x IS NOT NULL)) AS problem FROM customer")
def configuration_violations(spark, d):
    c, none = F.col("c_custkey"), F.lit(None).cast("double")
    names = F.when(c % 5 == 0, F.array(*map(F.lit, ("threads", "presolve", "random_seed")))).when(c % 3 == 0, F.array(F.lit("presolve")))
    settings = read(spark, d, "customer").select(c.alias("id"), F.when(c % 7 == 0, 0.0).otherwise(10.0).alias("time_limit"), F.when(c % 11 == 0, -0.1).alias("relative_gap"), none.alias("absolute_gap"), F.when(c % 13 == 0, 0).alias("threads"), names.alias("options"))
    return problems.configuration_violations(settings)


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus = 'O' AND (o_orderkey % 3 = 0 OR coalesce(o_orderkey % 4 = 0, false)) ELSE o_orderstatus IN ('O', 'F') END AS accepted FROM orders")
def result_acceptance(spark, d):
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "optimal").when(F.col("o_orderstatus") == "F", "feasible").otherwise("time_limit")
    gap = F.when(k % 4 == 0, 0.0).when(k % 4 == 1, 0.1)
    return read(spark, d, "orders").select("o_orderkey", problems.acceptable(status, gap, F.when(F.col("o_custkey") % 2 == 0, "exact_audit").otherwise("standard"), k % 3 != 0).alias("accepted"))


@query("SELECT o_orderkey AS task_id, 3 AS source_id, CASE o_orderstatus WHEN 'O' THEN 'completed' WHEN 'F' THEN 'failed' ELSE 'queued' END AS status, o_orderdate AS created FROM orders")
def run_backfill(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "completed").when(F.col("o_orderstatus") == "F", "failed_to_submit").otherwise("draft")
    tasks = read(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), status.alias("status"), F.col("o_orderdate").alias("created"))
    return problems.backfilled(tasks, read(spark, d, "region").where("r_regionkey = 3").select(F.col("r_regionkey").alias("source_id")))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 9 END WHEN o_orderkey % 2 = 0 THEN 1 END AS started_at, CASE WHEN o_orderstatus = 'F' THEN 9 END AS completed_at FROM orders")
def state_times(spark, d):
    k = F.col("o_orderkey")
    rows = read(spark, d, "orders").select(k.alias("k"), F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "F", "failed").otherwise("queued").alias("status"), F.when(k % 2 == 0, 1).alias("started_at"), F.lit(None).cast("int").alias("completed_at"))
    return problems.started(rows, F.lit(9)).drop("status")
