"""The registered queries for the planning operators, on the given tables, with the same in SQL.

part is a grid of cells (row = p_partkey div 50), lineitem its layers, orders a finer raster (row = o_orderkey div 100).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import geo, masks
from terrane.functions.shared import save
from terrane.operators import graph, grid, metadata, model, resample
from terrane.plans import objective as plan
from terrane.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
Q4 = lambda c: F.round(c, 4)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cells(spark, d) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return p.select(F.col("p_partkey").alias("unit"), F.floor(F.col("p_partkey") / 50).alias("row"), (F.col("p_partkey") % 50).alias("col"), "p_size", F.col("p_retailprice").cast("double").alias("price"))


def values(spark, d) -> DataFrame:
    """layer, unit, amount: three layers from lineitem."""
    rows = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("unit")).agg(F.sum("l_quantity").cast("double").alias("a"), F.sum("l_extendedprice").cast("double").alias("b"), F.avg("l_discount").cast("double").alias("c"))
    return rows.select("unit", F.inline(F.array(*(F.struct(F.lit(x).alias("layer"), F.col(x).alias("amount")) for x in "abc"))))


def raster(spark, d) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return o.select(F.floor(F.col("o_orderkey") / 100).alias("row"), (F.col("o_orderkey") % 100).alias("col"), F.round(F.col("o_totalprice").cast("double") * 100).alias("value"))


def states(spark, d) -> DataFrame:
    state = F.when(F.col("p_size") % 17 == 0, 0).when(F.col("p_size") % 19 == 0, 1).otherwise(-1)
    return cells(spark, d).withColumn("state", state)


def units(spark, d) -> DataFrame:
    """unit, objective, cost of a selection problem."""
    rows = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("unit")).agg(F.sum("l_quantity").cast("double").alias("objective"), F.sum("l_extendedprice").cast("double").alias("cost"))
    return rows


CELLS = "cells AS (SELECT p_partkey AS unit, p_partkey // 50 AS row, p_partkey % 50 AS col, p_size, p_retailprice::DOUBLE AS price FROM part)"
RASTER = "raster AS (SELECT o_orderkey // 100 AS row, o_orderkey % 100 AS col, round(o_totalprice::DOUBLE * 100) AS value FROM orders)"
LAYERS = "l AS (SELECT l_partkey AS unit, sum(l_quantity)::DOUBLE AS a, sum(l_extendedprice)::DOUBLE AS b, avg(l_discount)::DOUBLE AS c FROM lineitem GROUP BY 1), vals AS (SELECT 'a' AS layer, unit, a AS amount FROM l UNION ALL SELECT 'b', unit, b FROM l UNION ALL SELECT 'c', unit, c FROM l)"
STATES = CELLS + ", states AS (SELECT *, CASE WHEN p_size % 17 = 0 THEN 0 WHEN p_size % 19 = 0 THEN 1 ELSE -1 END AS state FROM cells)"
EDGES = STATES + ", edges AS (SELECT x.unit AS a, y.unit AS b, x.state AS sa, y.state AS sb FROM states x JOIN states y ON x.row = y.row AND x.col + 1 = y.col UNION ALL SELECT x.unit, y.unit, x.state, y.state FROM states x JOIN states y ON x.row + 1 = y.row AND x.col = y.col)"
UNITS = "units AS (SELECT l_partkey AS unit, sum(l_quantity)::DOUBLE AS objective, sum(l_extendedprice)::DOUBLE AS cost FROM lineitem GROUP BY 1)"
PROBLEM = (("a", "maximize", 1.0), ("b", "minimize", 0.5), ("c", "maximize", 2.0))


def problem(spark) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(a).alias("layer"), F.lit(b).alias("direction"), F.lit(c).alias("importance")) for a, b, c in PROBLEM))))


SCALES = LAYERS + f""", p AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in PROBLEM)}) AS p(layer, direction, importance)),
k AS (SELECT layer, sum(amount) AS scale FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY amount DESC, unit) AS k FROM vals WHERE amount > 0) WHERE k <= 20 GROUP BY 1),
n AS (SELECT p.*, scale, CASE WHEN scale > 0 THEN CASE direction WHEN 'minimize' THEN -1 ELSE 1 END * importance / scale ELSE 0 END AS coefficient FROM p LEFT JOIN k USING (layer)),
f AS (SELECT unit, sum(coefficient * amount) AS objective FROM vals JOIN n USING (layer) GROUP BY 1)"""


@query(f"WITH {SCALES} SELECT unit, round(objective, 8) AS objective FROM f ORDER BY objective DESC, unit LIMIT 25")
def flagship_objective(spark, d):
    return plan.best(plan.objective(values(spark, d), problem(spark), 20), 25).select("unit", F.round("objective", 8).alias("objective"))


@query(f"WITH {SCALES} SELECT layer, round(scale, 4) AS scale, round(coefficient, 10) AS coefficient FROM n")
def objective_normalization(spark, d):
    rows = model.normalised(F.broadcast(problem(spark)).join(model.top_k_scale(values(spark, d), 20), "layer", "left"))
    return rows.select("layer", Q4("scale").alias("scale"), F.round("coefficient", 10).alias("coefficient"))


@query(f"WITH {SCALES} SELECT unit, round(objective, 8) AS objective FROM f")
def fused_objective(spark, d):
    return plan.objective(values(spark, d), problem(spark), 20).select("unit", F.round("objective", 8).alias("objective"))


@query(f"WITH {CELLS} SELECT row * 50 + col AS cell_id, row, col, 0.0::DOUBLE + 15 + col * 30 AS x, 0.0::DOUBLE - (row + 0.5) * 30 AS y FROM cells")
def grid_cells(spark, d):
    x, y = grid.centre(F.col("row"), F.col("col"), grid.Grid(0.0, 0.0, 30.0, 1 << 30, 50))
    return cells(spark, d).select(grid.cell_id(F.col("row"), F.col("col"), 50).alias("cell_id"), "row", "col", x.alias("x"), y.alias("y"))


OK = "price BETWEEN 920 AND 1800"


@query(
    f"WITH {CELLS}, t AS (SELECT row // 16 AS tile_r, col // 16 AS tile_c, count(*) AS cells, count(*) FILTER ({OK}) AS units FROM cells GROUP BY 1, 2) "
    "SELECT tile_r, tile_c, cells, units, round(units / cells, 6) AS valid_fraction, coalesce(sum(units) OVER (ORDER BY tile_r, tile_c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS index_offset FROM t"
)
def tile_counts_prefix(spark, d):
    return grid.tile_counts(grid.in_tiles(cells(spark, d), 16), F.expr(OK)).withColumn("valid_fraction", F.round("valid_fraction", 6))


@query(f"WITH {CELLS} SELECT unit, row_number() OVER (ORDER BY row // 16, col // 16, row, col) - 1 AS variable_index FROM cells WHERE {OK}")
def dense_variable_index(spark, d):
    return grid.dense_index(grid.in_tiles(cells(spark, d), 16), F.expr(OK)).select("unit", "variable_index")


@query(f"WITH {CELLS}, {LAYERS} SELECT unit, price FROM cells LEFT JOIN l USING (unit) WHERE a IS NOT NULL AND price BETWEEN 920 AND 1800 AND a >= 500")
def eligibility_bounds(spark, d):
    wide = cells(spark, d).join(values(spark, d).where("layer = 'a'").select("unit", F.col("amount").alias("a")), "unit", "left")
    return wide.where(grid.eligible(wide, ["a"], {"price": (920, 1800), "a": (500, None)})).select("unit", "price")


@query(
    f"WITH {CELLS}, {LAYERS}, w AS (SELECT coalesce(price BETWEEN 920 AND 1800, false) AS p, coalesce(a >= 500, false) AS q FROM cells LEFT JOIN l USING (unit)) "
    "SELECT 0 AS step, 'price' AS predicate, count(*) AS units_in, count(*) FILTER (p) AS units_out FROM w UNION ALL SELECT 1, 'amount', count(*) FILTER (p), count(*) FILTER (p AND q) FROM w"
)
def predicate_telemetry(spark, d):
    wide = cells(spark, d).join(values(spark, d).where("layer = 'a'").select("unit", F.col("amount").alias("a")), "unit", "left")
    return grid.telemetry(wide, {"price": F.expr(OK), "amount": F.col("a") >= 500})


@query(f"WITH {LAYERS} SELECT layer AS feature_index, count(*) AS nnz, round(sum(amount), 2) AS total, round(sum(amount) FILTER (amount > 0), 2) AS positive FROM vals WHERE amount <> 0 GROUP BY 1")
def feature_nnz(spark, d):
    rows = grid.sparse(values(spark, d))
    return rows.groupBy(F.col("layer").alias("feature_index")).agg(F.count("*").alias("nnz"), F.round(F.sum("amount"), 2).alias("total"), F.round(F.sum(F.when(F.col("amount") > 0, F.col("amount"))), 2).alias("positive"))


_SQL = {"sum": "sum(value)", "area_weighted_mean": "avg(value)", "median": "median(value)", "maximum": "max(value)", "minimum": "min(value)"}


def _nested(statistic: str):
    def f(spark, d):
        return resample.aggregate(raster(spark, d), 4, statistic).withColumn("value", Q4("value"))

    f.__name__ = f"nested_{statistic}"
    query(f"WITH {RASTER} SELECT row // 4 AS row, col // 4 AS col, round({_SQL[statistic]}, 4) AS value FROM raster GROUP BY 1, 2")(f)


for _s in _SQL:
    _nested(_s)


@query(
    "WITH v AS (SELECT p_partkey // 50 // 4 AS row, p_partkey % 50 // 4 AS col, p_size::DOUBLE AS value, count(*) AS n FROM part GROUP BY 1, 2, 3) "
    "SELECT row, col, value FROM v QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY n DESC, value) = 1"
)
def nested_mode(spark, d):
    return resample.aggregate(cells(spark, d).select("row", "col", F.col("p_size").cast("double").alias("value")), 4, "mode")


def _pyramid(statistic: str, sql: str):
    def f(spark, d):
        return resample.pyramid(raster(spark, d), 3, statistic).withColumn("value", Q4("value"))

    f.__name__ = f"pyramid_{statistic}"
    one = lambda a, b: f"{b} AS (SELECT row // 2 AS row, col // 2 AS col, {sql}(value) AS value FROM {a} GROUP BY 1, 2)"
    levels = " UNION ALL ".join(f"SELECT {k} AS level, row, col, round(value, 4) AS value FROM l{k}" for k in (1, 2, 3))
    query(f"WITH {RASTER}, {one('raster', 'l1')}, {one('l1', 'l2')}, {one('l2', 'l3')} {levels}")(f)


_pyramid("maximum", "max")
_pyramid("area_weighted_mean", "avg")


@query(
    f"""WITH {RASTER}, t AS (SELECT *, unnest(range(floor(row / 1.5)::BIGINT, ceil((row + 1) / 1.5)::BIGINT)) AS tr FROM raster), u AS (SELECT *, unnest(range(floor(col / 1.5)::BIGINT, ceil((col + 1) / 1.5)::BIGINT)) AS tc FROM t),
w AS (SELECT tr, tc, value, greatest(0, least(row + 1, (tr + 1) * 1.5) - greatest(row, tr * 1.5)) * greatest(0, least(col + 1, (tc + 1) * 1.5) - greatest(col, tc * 1.5)) AS w FROM u)
SELECT tr AS row, tc AS col, round((sum(value * w) / sum(w))::DOUBLE, 4) AS value FROM w WHERE w > 1e-9 GROUP BY 1, 2"""
)
def overlap_resample(spark, d):
    return resample.overlap(raster(spark, d), 1.5, False).withColumn("value", Q4("value"))


@query(f"WITH {EDGES} SELECT a, b FROM edges")
def rook_edges(spark, d):
    return graph.rook_edges(cells(spark, d))


@query(
    f"""WITH {EDGES} SELECT count(*) AS raw, count(*) FILTER (sa <> -1 AND sb <> -1) AS constant, count(*) FILTER (sa = 1 AND sb = 1) AS constant_selected, count(*) FILTER ((sa = -1) <> (sb = -1)) AS unary,
count(*) FILTER ((sa = -1) <> (sb = -1) AND greatest(sa, sb) = 0) AS fixed0_unary, count(*) FILTER ((sa = -1) <> (sb = -1) AND greatest(sa, sb) = 1) AS fixed1_unary, count(*) FILTER (sa = -1 AND sb = -1) AS pairwise FROM edges"""
)
def edge_classification(spark, d):
    s = states(spark, d)
    return graph.classify(graph.with_states(graph.rook_edges(s), s, ["state"]))


@query(f"WITH {EDGES}, s AS (SELECT unit, (p_size % 10) / 8.0 AS x FROM cells) SELECT round(sum(least(least(greatest(p.x, 0), 1), least(greatest(q.x, 0), 1)))::DOUBLE, 4) AS pair_value FROM edges JOIN s p ON p.unit = a JOIN s q ON q.unit = b")
def pair_value_continuous(spark, d):
    s = cells(spark, d)
    x = s.select("unit", ((F.col("p_size") % 10) / 8.0).alias("x"))
    return graph.pair_value(graph.with_states(graph.rook_edges(s), x, ["x"]), True).select(Q4("pair_value").alias("pair_value"))


@query(f"WITH {EDGES}, s AS (SELECT unit, (p_size % 10) / 8.0 AS x FROM cells) SELECT (count(*) FILTER (p.x >= 0.5 AND q.x >= 0.5))::DOUBLE AS pair_value FROM edges JOIN s p ON p.unit = a JOIN s q ON q.unit = b")
def pair_value_discrete(spark, d):
    s = cells(spark, d)
    x = s.select("unit", ((F.col("p_size") % 10) / 8.0).alias("x"))
    return graph.pair_value(graph.with_states(graph.rook_edges(s), x, ["x"]), False)


@query(f"WITH {EDGES} SELECT unit, count(*) AS degree FROM (SELECT a AS unit FROM edges UNION ALL SELECT b FROM edges) GROUP BY 1")
def neighbor_degree(spark, d):
    return graph.degrees(graph.rook_edges(cells(spark, d)))


@query(
    f"""WITH {EDGES}, o AS (SELECT unit, state, (p_size - 30) / 10.0 AS objective FROM states), e AS (SELECT a AS unit, b AS other FROM edges UNION ALL SELECT b, a FROM edges),
g AS (SELECT e.unit, count(*) AS n FROM e JOIN o ON e.other = o.unit WHERE o.state <> 0 GROUP BY 1) SELECT unit, CASE WHEN state = -1 AND objective + 0.25 * coalesce(n, 0) <= 1e-12 THEN 0 ELSE state END AS state FROM o LEFT JOIN g USING (unit)"""
)
def presolve_one_round(spark, d):
    s = states(spark, d)
    o = s.select("unit", "state", ((F.col("p_size") - 30) / 10.0).alias("objective"))
    return graph.reduce_once(o, graph.rook_edges(s), 0.25).select("unit", "state")


@query()
def presolve_fixpoint(spark, d):
    s = states(spark, d)
    o = s.select("unit", "state", ((F.col("p_size") - 30) / 10.0).alias("objective"))
    return graph.reduce_fixpoint(o, graph.rook_edges(s), 0.25, save)[0].select("unit", "state")


_NZ = "nz AS (SELECT l_suppkey AS row_id, l_partkey AS unit, sum(l_quantity - 25)::DOUBLE AS coef FROM lineitem GROUP BY 1, 2)"


def nonzeros(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("row_id"), F.col("l_partkey").alias("unit")).agg(F.sum(F.col("l_quantity") - 25).cast("double").alias("coef"))


@query(f"WITH {CELLS}, {_NZ} SELECT row_id, round(sum(coef * (p_size % 5) / 4.0)::DOUBLE, 4) AS activity FROM nz JOIN cells USING (unit) GROUP BY 1")
def csr_row_activity(spark, d):
    x = cells(spark, d).select("unit", ((F.col("p_size") % 5) / 4.0).alias("x"))
    return model.activity(nonzeros(spark, d), x).select("row_id", Q4("activity").alias("activity"))


@query(f"WITH {_NZ} SELECT row_id, round(coalesce(sum(coef) FILTER (coef < 0), 0)::DOUBLE, 4) AS least, round(coalesce(sum(coef) FILTER (coef > 0), 0)::DOUBLE, 4) AS greatest FROM nz GROUP BY 1")
def possible_bounds(spark, d):
    return model.possible(nonzeros(spark, d)).select("row_id", Q4("least").alias("least"), Q4("greatest").alias("greatest"))


@query("SELECT round(max(greatest(910 - p_retailprice::DOUBLE, p_retailprice::DOUBLE - 1500, 0)), 4) AS bound_violation, round(max(abs(p_size / 4.0 - round_even(p_size / 4.0, 0)))::DOUBLE, 4) AS integrality_violation FROM part")
def solution_violations(spark, d):
    rows = cells(spark, d).withColumn("x", F.col("p_size") / 4.0)
    return rows.agg(F.round(model.bound_violation("price", F.lit(910.0), F.lit(1500.0)), 4).alias("bound_violation"), F.round(model.integrality_violation("x"), 4).alias("integrality_violation"))


_SPENT = "s AS (SELECT *, sum(cost) OVER (ORDER BY objective / cost DESC, unit ROWS UNBOUNDED PRECEDING) AS spent FROM units WHERE objective > 0)"


@query(f"WITH {UNITS}, {_SPENT} SELECT unit, round(spent, 2) AS spent FROM s WHERE spent <= 5e6 + 1e-9")
def greedy_budget_select(spark, d):
    return model.greedy(units(spark, d), 5e6).select("unit", F.round("spent", 2).alias("spent"))


@query(f"WITH {UNITS}, {_SPENT} SELECT unit, round(least(1, (5e6 - (spent - cost)) / cost), 6) AS x FROM s WHERE 5e6 - (spent - cost) > 0")
def fractional_knapsack(spark, d):
    return model.fractional(units(spark, d), 5e6).select("unit", F.round("x", 6).alias("x"))


@query(
    f"WITH {UNITS}, r AS (SELECT unit, row_number() OVER (ORDER BY objective DESC, unit) AS rank, count(*) OVER () AS n FROM units) "
    "SELECT unit, rank::BIGINT AS rank, round((least(greatest(n * 0.25 - (rank - 1), 0), 1) + least(greatest(n * 0.5 - (rank - 1), 0), 1) + least(greatest(n * 1.0 - (rank - 1), 0), 1)) / 3, 6)::DOUBLE AS priority FROM r"
)
def priority_ranking_mean(spark, d):
    return model.priority(units(spark, d), [0.25, 0.5, 1.0]).withColumn("priority", F.round("priority", 6))


@query(
    f"WITH {UNITS}, r AS (SELECT unit, objective, row_number() OVER (ORDER BY objective DESC, unit) AS rank FROM units), s AS (SELECT coalesce(max(objective) FILTER (rank = 51), 0) AS spare FROM r) "
    "SELECT unit, round(CASE WHEN rank <= 50 THEN objective - spare ELSE 0 END, 4) AS loss FROM r, s"
)
def irreplaceability_cardinality(spark, d):
    return model.irreplaceability(units(spark, d), 50).select("unit", Q4("loss").alias("loss"))


@query("SELECT user_id, run, event_type, min(at) AS start, max(at) + 1 AS stop FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS run FROM (SELECT user_id, ts, event_id, event_type, row_number() OVER w - 1 AS at, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY ALL".replace(" at ", " pos ").replace("min(at)", "min(pos)").replace("max(at)", "max(pos)").replace("AS at,", "AS pos,"))
def run_length_blocks(spark, d):
    return metadata.runs(read(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "event_type", ["ts", "event_id"])


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark, d):
    return metadata.latest(read(spark, d, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT c_custkey, n_name, r_name, count(o_orderkey) AS orders FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 7 <> 0 GROUP BY ALL")
def profile_tasks_join(spark, d):
    ended = F.when(F.col("c_custkey") % 7 == 0, F.current_timestamp())
    c = metadata.live(read(spark, d, "customer").withColumn("record_end_date", ended))
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(counts, "c_custkey", "left").select("c_custkey", "n_name", "r_name", F.coalesce("orders", F.lit(0)).cast("long").alias("orders"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 20 = 0)")
def anti_insert(spark, d):
    return metadata.insert_missing(read(spark, d, "orders").where("o_orderkey % 20 = 0").select(F.col("o_custkey").alias("c_custkey")), read(spark, d, "customer").select("c_custkey"), ["c_custkey"])


@query("SELECT doc_id, source FROM documents WHERE source ILIKE '%C1%' OR coalesce(lang, '') ILIKE '%C1%' ORDER BY doc_id DESC LIMIT 25 OFFSET 25")
def paginate_search(spark, d):
    hits = metadata.search(read(spark, d, "documents").select("doc_id", "source", "lang"), "C1", ["source", "lang"])
    return metadata.page(hits, 2, 25, [F.desc("doc_id")]).select("doc_id", "source")


@query("SELECT count(*) AS total, 2 AS current_page, greatest(1, ceil(count(*) / 25))::BIGINT AS last_page, 25 AS per_page FROM documents WHERE source ILIKE '%C1%'")
def pagination_info(spark, d):
    return metadata.page_info(metadata.search(read(spark, d, "documents"), "C1", ["source"]), 2, 25)


@query("SELECT o_custkey AS key, CASE WHEN o_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS origin FROM (SELECT DISTINCT o_custkey FROM orders)")
def upsert_latest(spark, d):
    keys = read(spark, d, "orders").select(F.col("o_custkey").alias("key")).distinct()
    return metadata.upsert(keys.withColumn("origin", F.lit("old")), keys.where("key % 2 = 0").withColumn("origin", F.lit("new")), ["key"])


@query("SELECT c_custkey, count(o_orderkey) AS n, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def nested_collect(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    rows = metadata.with_children(read(spark, d, "customer").select("c_custkey"), o, "c_custkey", ["o_orderkey"], "children")
    return rows.select("c_custkey", F.size("children").cast("long").alias("n"), F.array_join(F.transform("children", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


@query(
    "WITH b AS (SELECT o_orderkey AS key, o_orderstatus AS s FROM orders WHERE o_orderkey % 5 <> 0), a AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 7 <> 0) "
    "SELECT key, CASE WHEN b.key IS NULL THEN 'INSERT' WHEN a.key IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS operation FROM b FULL JOIN a USING (key) WHERE b.key IS NULL OR a.key IS NULL OR a.s IS DISTINCT FROM b.s".replace("SELECT key, CASE", "SELECT coalesce(b.key, a.key) AS key, CASE")
)
def cdc_audit(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("s"))
    after = o.where("key % 7 <> 0").withColumn("s", F.when(F.col("key") % 3 != 0, F.col("s")))
    return metadata.changed(o.where("key % 5 <> 0"), after, "key", ["s"]).select("key", "operation")


@query("SELECT event_id, user_id, event_type, before FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL AND NOT (before = 'view' AND event_type IN ('click', 'purchase') OR before = 'click' AND event_type = 'purchase')")
def status_machine_violations(spark, d):
    rows = read(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return metadata.bad_transitions(rows, "user_id", "event_type", ["ts", "event_id"], {"view": ("click", "purchase"), "click": ("purchase",)}).drop("ts")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_extract_props(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT p_partkey // 32768 AS chunk, count(*) AS bits FROM part WHERE p_size % 3 = 0 GROUP BY 1")
def mask_bitcount(spark, d):
    p = read(spark, d, "part").where("p_size % 3 = 0").select(F.col("p_partkey").cast("long").alias("position"))
    return masks.pack(p, []).select("chunk", "bits")


@query("SELECT c_custkey, round(abs(radians(1.0) * 2 * (sin(radians(c_custkey % 60 + 1.0)) - sin(radians((c_custkey % 60)::DOUBLE))) / 2 * 6371008.8 * 6371008.8) / 1e6, 3) AS area_km2 FROM customer")
def spherical_ring_area(spark, d):
    y = (F.col("c_custkey") % 60).cast("double")
    point = lambda a, b: F.struct(F.lit(a).alias("x"), b.alias("y"))
    ring = F.array(point(10.0, y), point(11.0, y), point(11.0, y + 1), point(10.0, y + 1))
    return read(spark, d, "customer").select("c_custkey", F.round(geo.spherical_area(ring) / 1e6, 3).alias("area_km2"))


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def events_change_notify(spark, d):
    visible = read(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"))
    rows = changes.notifications(read(spark, d, "events"), visible)
    return rows.select(F.get_json_object("envelope", "$.event_id").cast("long").alias("event_id"), F.get_json_object("envelope", "$.user_id").cast("long").alias("user_id"))
