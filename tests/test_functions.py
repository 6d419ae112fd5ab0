"""Functions that no registered query calls, each also with NULL, NaN or empty input."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from terrane.functions import contracts, geo, masks, scalars
from terrane.operators import compiler, graph, grid, metadata, model, problems, resample, states, validation
from terrane.sources import tables
from terrane.streaming import changes


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_grids():
    assert grid.level(240) == 3
    with pytest.raises(ValueError):
        grid.level(50)
    g = grid.build_grid((105, 205, 295, 390), (0, 0, 1000, 1000), 30)
    assert (g.row_offset, g.col_offset, g.height, g.width, g.x, g.y) == (20, 3, 7, 7, 90, 400)
    assert g.area == 7 * 7 * 900
    with pytest.raises(ValueError):
        grid.build_grid((2000, 0, 2100, 50), (0, 0, 1000, 1000), 30)


def test_tiles_and_padded_windows(spark):
    got = [tuple(r) for r in grid.tiles(spark, grid.Grid(0, 0, 30, 5, 3), 2).orderBy("tile_id").collect()]
    assert len(got) == 6 and got[-1] == ("r000000004-c000000002", 4, 5, 2, 3)
    layer = spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.0), (9, 9, 3.0)], "row long, col long, value double")
    window = {(r.row, r.col): r.value for r in grid.padded(layer, spark, (-1, 2), (0, 2)).collect()}
    assert len(window) == 6 and window[0, 0] == 1.0 and window[1, 1] == 2.0 and window[-1, 0] is None
    values = [r.v for r in spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "v double").select(grid.finite(F.col("v")).alias("v")).collect()]
    assert values == [1.0, None, None, None]


def test_ranks_of_a_large_group(spark):
    rows = [("a" if k % 4 else "b", float(k * 7 % 101), k) for k in range(400)] + [("c", None, 1000)]
    frame = spark.createDataFrame(rows, "layer string, amount double, unit long")
    got = {(r.layer, r.unit): r.rank for r in grid.ranks_within(frame, "layer", [F.desc("amount"), F.asc("unit")], "rank").collect()}
    for layer in "abc":
        order = sorted((r for r in rows if r[0] == layer), key=lambda r: (-(r[1] or 0), r[2]))
        assert [got[layer, r[2]] for r in order] == list(range(1, len(order) + 1))
    few = {r.layer: r.scale for r in model.top_k_scale(frame, 5).collect()}
    model_small, model.SMALL = model.SMALL, 0
    try:
        assert {r.layer: r.scale for r in model.top_k_scale(frame, 5).collect()} == few
    finally:
        model.SMALL = model_small
    assert [r.n for r in grid.numbered(frame.where("layer = 'b'"), [F.asc("unit")], "n").orderBy("unit").collect()] == list(range(100))
    assert grid.numbered(frame.limit(0), [F.asc("unit")], "n").count() == 0


def test_contracts(spark):
    rows = [("ok", "amount", "sum", "extensive", None), ("kind", "odd", "sum", "extensive", None), ("mode", "categorical", "mode", "amount", None), ("sum", "cost", "sum", "intensive", None), ("not", "density", "sum", "extensive", None), ("none", "density", None, None, None)]
    got = {}
    for r in contracts.violations(spark, spark.createDataFrame(rows, "layer string, kind string, statistic string, quantity string, tie_rule string")).collect():
        got.setdefault(r.layer, set()).add(r.problem)
    assert got == {"kind": {"unknown kind"}, "mode": {"unknown quantity", "mode needs a categorical quantity", "mode needs the lowest value on ties"}, "sum": {"sum needs an extensive quantity"}, "not": {"statistic not admitted"}, "none": {"statistic not admitted", "unknown quantity"}}
    cases = [(30, 120, 0, 0, None, "nested_aggregate"), (120, 120, 0, 0, None, "direct"), (120, 120, 7, 0, None, "bounded_reproject"), (240, 120, 0, 0, "nearest_constant", "coarse_to_fine_supported"), (240, 120, 0, 0, "prohibit", "unsupported"), (50, 120, 0, 0, None, "bounded_reproject")]
    frame = spark.createDataFrame([tuple(map(float, c[:4])) + c[4:] for c in cases], "native double, target double, x double, y double, policy string, want string")
    mapped = frame.select(contracts.mapping(*(F.col(c) for c in ("native", "target", "x", "y", "policy"))).alias("got"), "want").collect()
    assert [r.got for r in mapped] == [r.want for r in mapped]


def test_canonical_json_and_admission():
    value = {"b": [1, {"z": None, "a": "é"}], "a": 1.5}
    text = '{"a":1.5,"b":[1,{"a":"é","z":null}]}'
    assert contracts.canonical_json(value) == text and contracts.canonical_hash(value) == hashlib.sha256(text.encode()).hexdigest()
    assert contracts.footprint(10, 5, 20, safety=1.0) == 10 * 62 + 20 * 24 + 5 * 48 + 16
    assert contracts.footprint(10, 5, 20, 2, 1.0) == contracts.footprint(12, 9, 28, 0, 1.0)
    assert [contracts.admit(*x) for x in ((1, 1), (9 << 30, 0), (0, 65 << 30), (9 << 30, 65 << 30))] == ["admitted", "peak_memory", "scratch", "peak_memory"]


def test_geometry(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))))
    points = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (None, 1.0)], "x double, y double")
    assert [r.i for r in points.select(geo.in_ring(F.col("x"), F.col("y"), ring).alias("i")).collect()][:2] == [True, False]
    x, y = geo.web_mercator(F.lit(180.0), F.lit(0.0))
    r = one(spark, x.alias("x"), y.alias("y"), geo.closed(ring).alias("c"), geo.closed(F.slice(ring, 1, 3)).alias("o"), geo.closed(F.lit(None).cast("array<struct<x:double,y:double>>")).alias("n"))
    assert abs(r.x - 20037508.342789) < 1e-5 and abs(r.y) < 1e-6 and (r.c, r.o, r.n) == (True, False, False)
    empty = F.array().cast("array<array<struct<x:double,y:double>>>")
    assert one(spark, geo.polygon_area(empty).alias("a")).a == 0


def test_geojson(spark):
    ring = [[0, 0], [4, 0], [4, 4], [0, 0]]
    texts = {
        "polygon": {"type": "Polygon", "coordinates": [ring, ring]},
        "multi": {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring, ring]]}},
        "collection": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2]}, {"type": "Polygon", "coordinates": [ring]}]},
        "features": {"type": "FeatureCollection", "features": [{"geometry": {"type": "Polygon", "coordinates": [ring]}}, {"geometry": None}]},
        "empty": {"type": "FeatureCollection", "features": []},
    }
    frame = spark.createDataFrame([(k, json.dumps(v)) for k, v in texts.items()] + [("null", None), ("bad", "{no")], "id string, text string")
    got = {}
    for r in tables.rings(frame, "text").collect():
        got.setdefault(r.id, []).append((r.polygon_no, r.ring_no, len(r.ring)))
    assert {k: sorted(v) for k, v in got.items()} == {"polygon": [(0, 0, 4), (0, 1, 4)], "multi": [(0, 0, 4), (1, 0, 4), (1, 1, 4)], "collection": [(0, 0, 4)], "features": [(0, 0, 4)]}
    with pytest.raises(Exception, match="no polygon"):
        frame.where("id = 'empty'").select(tables.area_in(F.col("text"))).collect()
    assert tables.rings(frame.limit(0), "text").count() == 0


def test_tables(spark, tmp_path):
    layer = spark.createDataFrame([(0, 0, 1.0), (0, 1, float("nan")), (1, 0, None)], "row long, col long, value double")
    tables.publish(layer, f"{tmp_path}/layer")
    assert sorted((r.row, r.col, r.value) for r in tables.read_layer(spark, f"{tmp_path}/layer").where("value IS NOT NULL").collect()) == [(0, 0, 1.0)]
    assert tables.read_layer(spark, f"{tmp_path}/layer").count() == 3
    tables.publish(layer, f"{tmp_path}/by_row", "row")
    assert spark.read.parquet(f"{tmp_path}/by_row").where("row = 1").count() == 1
    cells = spark.createDataFrame([(1, 0, 1, 1), (2, 0, 2, 0)], "grid_cell_id long, row long, col long, decision int")
    assert [tuple(r) for r in tables.selected(cells).collect()] == [(1, 0, 1, 1)] and tables.selected(cells.limit(0)).columns == ["grid_cell_id", "row", "col", "decision"]
    meta = json.dumps({"metadata": {"a/b/.zarray": {"shape": [2]}, "a/x/.zarray": {"shape": [2]}, "c/.zarray": {}, ".zgroup": {}, "a/a/.zarray": {"shape": [1]}}})
    arrays = tables.arrays_in(spark.createDataFrame([(meta,)], "m string"), "m")
    assert [tuple(r) for r in arrays.collect()] == [("a/a", "a", "a"), ("a/b", "a", "b")] or [r.path for r in arrays.collect()] == ["a/a", "a/b"]
    assert [r.path for r in tables.catalog(arrays, " B ").collect()] == ["a/b"] and tables.catalog(arrays, "", ("z",)).count() == 0
    files = spark.createDataFrame([("a", b"1"), ("b", b"2")], "path string, content binary")
    sha = lambda x: hashlib.sha256(x).hexdigest()
    root = tables.content_root(files).first().content_sha256
    assert root == sha(f"a:{sha(b'1')}\nb:{sha(b'2')}".encode()) and root == tables.content_root(files.orderBy(F.desc("path"))).first().content_sha256
    manifest = spark.createDataFrame([("a", sha(b"1")), ("b", sha(b"x")), ("c", sha(b"3"))], "path string, sha256 string")
    assert {tuple(r) for r in tables.corrupt(files.unionByName(spark.createDataFrame([("d", b"4")], files.schema)), manifest).collect()} == {("b", "differs"), ("c", "missing"), ("d", "unexpected")}
    inside = spark.createDataFrame([("a/b",), ("/a",), ("a/../b",), ("a..b",)], "p string").select(tables.inside(F.col("p")).alias("i")).collect()
    assert [r.i for r in inside] == [True, False, False, True]
    tiles = spark.createDataFrame([('{"tile_id": "t", "row_start": 1, "count": 3, "layers": {"a": 2}}',), ("{",), (None,)], "j string")
    assert [(r.tile_id, r["count"], r.layers) for r in tables.tile_records(tiles, "j").collect()] == [("t", 3, {"a": 2})]
    xs = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "at long, x double")
    assert sorted(r.at for r in tables.coordinates_differ(xs, xs.where("at < 2").withColumn("x", F.col("x") + F.col("at") * 0.1), "x", 0.01).collect()) == [1, 2]


def test_masks_round_trip(spark):
    want = [0, 1, 7, 8, 31, 32767, 32768, 70000]
    rows = masks.pack(spark.createDataFrame([(k,) for k in want], "position long"), [])
    got = rows.select("chunk", F.explode(masks.unpack("mask")).alias("p")).collect()
    assert sorted(r.chunk * masks.SPAN + r.p for r in got) == want
    assert spark.createDataFrame([(None,)], "mask string").select(masks.unpack("mask").alias("p")).first().p is None


def test_resampling(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "row long, col long, value double")
    assert sorted(tuple(r) for r in resample.nearest(cells, 2).where("row = 1").collect()) == [(1, 0, 1.0), (1, 1, 1.0), (1, 2, 2.0), (1, 3, 2.0)]
    assert [tuple(r) for r in resample.overlap(cells, 2.0, True).collect()] == [(0, 0, 3.0)]
    assert resample.pick_overview([2, 4, 8], 3.2) == 4 and resample.pick_overview([2, 4], 9) == 4
    fine = spark.createDataFrame([(r, c, float(r * c) if r != 3 else float("nan")) for r in range(5) for c in range(3)], "row long, col long, value double")
    from terrane.functions.shared import save

    got = {(r.level, r.row, r.col): r.value for r in resample.overviews(fine, "priority", 2, save).collect()}
    assert got[1, 0, 0] == 0.25 and got[1, 1, 0] == 1.0 and got[2, 0, 0] == (0.25 + 1.0 + 1.0 + 4.0) / 4 and max(k[0] for k in got) == 2
    assert resample.overviews(fine.limit(0), "priority", 2, save).count() == 0
    assert resample.overviews(fine, "allocation", 512, save).count() == 0


def test_metadata(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, None, None)], "id long, name string, record_end_date int")
    gone = metadata.soft_delete(rows, F.col("id") < 3, F.lit(9))
    assert {(r.id, r.record_end_date) for r in gone.collect()} == {(1, 9), (2, 5), (3, None)} and [r.id for r in metadata.live(gone).collect()] == [3]
    new = spark.createDataFrame([(1, None), (3, "c"), (7, "x")], "id long, name string")
    assert {(r.id, r.name) for r in metadata.partial_update(rows, new, "id", ["name"]).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    runs = spark.createDataFrame([(1, "failed", 1), (1, "running", 2), (1, "completed", 3), (1, "running", 4)], "run long, status string, at long")
    assert [r.at for r in metadata.bad_transitions(runs, "run", "status", ["at"]).collect()] == [4]
    falling = spark.createDataFrame([(1, 0.1, 1.0), (1, 0.2, 0.5), (2, 0.1, 0.0), (2, 0.2, 1.0)], "unit long, budget double, x double")
    assert [tuple(r) for r in model.nested(falling).collect()] == [(1, 0.2)]
    folded = model.fold_fixed(spark.createDataFrame([(1, 5, 2.0), (1, 6, 3.0)], "row_id long, unit long, coef double"), spark.createDataFrame([(5, 1), (6, -1)], "unit long, state int"), spark.createDataFrame([(1, 1.0, 9.0), (2, 0.0, 1.0)], "row_id long, low double, high double"))
    assert {tuple(r) for r in folded.collect()} == {(1, -1.0, 7.0), (2, 0.0, 1.0)}
    assert {r.x for r in model.threshold(spark.createDataFrame([(1, 0.0), (2, 1.0)], "unit long, objective double")).collect()} == {0.0, 1.0}


def test_streams_of_changes(spark, tmp_path):
    schema = "event_id long, ts long, user_id long, event_type string"
    path, seen = f"{tmp_path}/events", []

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    def deliver(frame, name):
        query = changes.deliver(frame, lambda batch, _: seen.extend(tuple(r) for r in batch.collect()), f"{tmp_path}/{name}")
        query.awaitTermination()

    put([(1, 1, 5, "view"), (2, 2, 5, "view"), (3, 3, 6, None), (4, 4, 7, "click")])
    visible = spark.createDataFrame([(5,), (6,)], "user_id long")
    for _ in range(2):  # the second start has nothing new to send
        deliver(changes.notifications(changes.event_stream(spark, path), visible), "a")
    assert sorted(json.loads(x[0])["event_id"] for x in seen) == [1, 2, 3]
    seen.clear()
    follow = lambda: deliver(changes.changed_stream(changes.event_stream(spark, path), "user_id", ["event_type"], "event_id").select("event_id"), "b")
    follow()
    put([(5, 5, 5, "view"), (6, 6, 5, "buy"), (7, 7, 6, None), (8, 8, 7, None)])
    follow()
    batch = changes.changed_only(spark.read.parquet(path), "user_id", ["event_type"], ["event_id"])
    assert sorted(x[0] for x in seen) == [1, 3, 4, 6, 8] == sorted(r.event_id for r in batch.collect())
    assert {tuple(r) for r in changes.latest_state(spark.read.parquet(path)).collect()} == {(5, "buy", 6), (6, None, 7), (7, None, 8)}


def test_graph_protection_by_the_reference_case(spark):
    """A unit with a bad objective that a lower bound needs stays flexible."""
    units = spark.createDataFrame([(0, -1.0, -1), (1, -1.0, -1)], "unit long, objective double, state int")
    kept = graph.protected(spark.createDataFrame([(1, 0, 1.0)], "row_id long, unit long, coef double"), spark.createDataFrame([(1, 1.0, None)], "row_id long, low double, high double"))
    edges = spark.createDataFrame([], "a long, b long")
    assert {r.unit: r.state for r in graph.reduce_once(units, edges, 1.0, kept).collect()} == {0: -1, 1: 0}


def test_model_of_a_small_problem(spark):
    units = spark.createDataFrame([(0, 1.0, 1), (1, 2.0, -1), (2, -1.0, -1), (3, 5.0, 0)], "unit long, objective double, state int")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a long, b long")
    bounds = spark.createDataFrame([("f", 2.0, None), ("g", None, float("inf")), ("h", None, 100.0)], "feature string, low double, high double")
    relations = spark.createDataFrame([("f", 0, 1.0), ("f", 1, 1.0), ("f", 2, 1.0), ("h", 1, 3.0)], "feature string, unit long, coef double")
    m = compiler.build(units, edges, bounds, relations, 4.0, target=True)
    assert {(r.col, r.unit, r.a, r.b, r.objective, r.integer) for r in m.variables.collect()} == {(0, 1, None, None, 4.0, True), (1, 2, None, None, -1.0, True), (2, None, 1, 2, 2.0, False)}
    assert {(r.row, r.name, r.low, r.high) for r in m.rows.collect()} == {(0, "f_minimum", 1.0, None), (1, "allocation_target", 0.0, 0.0), (2, "pair_1", None, 0.0), (3, "pair_2", None, 0.0)}
    assert {tuple(r) for r in m.nonzeros.collect()} == {(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 1.0), (2, 2, 1.0), (2, 0, -1.0), (3, 2, 1.0), (3, 1, -1.0)}
    assert m.offset == 1.0
    x = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 1.0)], "col long, x double")
    rows = m.rows.where("name <> 'allocation_target'")
    got = validation.validated(m.variables, rows, m.nonzeros, x, m.offset, 6.0).first()
    assert (got.objective, got.failures) == (6.0, [])
    broken = validation.validated(m.variables, rows, m.nonzeros, x.withColumn("x", F.when(F.col("col") == 0, 1.4).otherwise(0.0)), m.offset, 0.0).first()
    assert set(broken.failures) == {"variable_bound_violation", "integrality_violation", "objective_mismatch"}
    impossible = spark.createDataFrame([("f", 9.0, None)], "feature string, low double, high double")
    with pytest.raises(Exception, match="infeasible"):
        compiler.feasible(compiler.simplified_rows(impossible, relations, units.withColumn("state", F.lit(0)))).collect()
    with pytest.raises(Exception, match="no value"):
        validation.validated(m.variables, rows, m.nonzeros, x.where("col = 0")).collect()
    with pytest.raises(Exception, match="both candidate"):
        validation.selected_units(units.select("unit", F.lit(1.0).alias("x")), units.where("unit = 0").select("unit", "state")).collect()
    with pytest.raises(ValueError):
        validation.rebuilt(units.select("unit", F.lit(1.0).alias("x")), units.where("unit = 0").select("unit", "state"), 4)


def test_odd_input_of_scalars(spark):
    s = lambda x: F.lit(x).cast("string")
    r = one(
        spark,
        scalars.utm(s("9N 500000 5000000")).alias("utm"), scalars.utm(s("61 500000 1")).alias("utm_zone"), scalars.utm(s(None)).alias("utm_null"), scalars.utm(s("9I 500000 1")).alias("utm_letter"),
        scalars.lat_long(s("+49.1 -122.6")).alias("ll"), scalars.lat_long(s("91 0")).alias("ll_out"), scalars.lat_long(s("")).alias("ll_empty"),
        scalars.phone(s("1 (250) 555-0199")).alias("phone"), scalars.phone(s("7")).alias("phone_short"), scalars.phone(s("250")).alias("phone_area"),
        scalars.budget(s("$1,234,567.899")).alias("budget"), scalars.budget(s("x")).alias("budget_none"), scalars.budget(s(".5")).alias("budget_point"),
        scalars.hex_colour(s(" #aB12 ")).alias("hex"), scalars.hex_colour(s("  ")).alias("hex_none"),
        scalars.integer_setting(s("1.2e3")).alias("n"), scalars.integer_setting(s("1.5")).alias("n_part"), scalars.integer_setting(s("nan")).alias("n_nan"), scalars.integer_setting(s("1e99")).alias("n_large"),
        scalars.seed_colour(s("")).alias("colour"), scalars.seed_colour(s(None)).alias("colour_null"), scalars.with_entry(s(None), "a", s("b")).alias("json"),
        scalars.array_path(s('"s3://bucket/a/b/"')).alias("path"), scalars.array_path(s("https://h/bucket//a/b?x"), "bucket").alias("path_web"), scalars.tile_url(s("s3://bucket"), "h").alias("no_key"),
        scalars.max_zoom(F.lit(None).cast("double")).alias("zoom"), scalars.status(s("Draft"), scalars.TILE_STATUSES).alias("status"), scalars.status(s("odd")).alias("status_odd"),
        scalars.emails(F.array(s(" A@x "), s("a@X"), s(""), s(None))).alias("emails"), F.array(*scalars.metatile(F.lit(7), F.lit(2))).alias("block"),
        validation.close(F.lit(1.0), F.lit(1.0 + 5e-8)).alias("close"), validation.close(F.lit(float("nan")), F.lit(float("nan"))).alias("close_nan"), scalars.segments_with(s("Land/Cover/Other"), " CO").alias("segments"),
        scalars.used_layers(F.array(s("a"), s("b")), F.array(s("b"), s("c"))).alias("layers"),
    )
    assert r.utm.srid == 32609 and r.utm.letter == "N" and (r.utm_zone, r.utm_null, r.utm_letter) == (None, None, None)
    assert tuple(r.ll) == (49.1, -122.6) and r.ll_out is None and r.ll_empty is None
    assert (r.phone, r.phone_short, r.phone_area) == ("+1 (250) 555-0199", "7", "(250)")
    assert (r.budget, r.budget_none, r.budget_point) == ("1,234,567.89", "", "0.5")
    assert (r.hex, r.hex_none) == ("#AB12", None) and (r.n, r.n_part, r.n_nan, r.n_large) == (1200, None, None, None)
    assert r.colour == "#5a5a6e" and r.colour_null is None and json.loads(r.json) == {"a": "b"}
    assert (r.path, r.path_web, r.no_key) == ("a/b", "a/b", None) and r.zoom is None and (r.status, r.status_odd) == ("draft", None)
    assert r.emails == ["a@x"] and r.block == [2, 0] and r.close and not r.close_nan and r.segments == ["cover"] and r.layers == ["a", "b", "c"]


def test_stored_states_of_odd_input(spark):
    runs = spark.createDataFrame([(1, "running", "discrete_optimization"), (2, "failed", None)], "run_id long, status string, task_type string")
    parts = spark.createDataFrame([(1, "pmtiles", "ready"), (1, "canonical_result", "ready")], "run_id long, type string, status string")
    solutions = spark.createDataFrame([(1, "reference"), (1, "other")], "run_id long, role string")
    asked = spark.createDataFrame([(1, "completed"), (2, "completed"), (3, "failed"), (2, None), (2, "running")], "run_id long, status string")
    got = sorted((r.run_id, r.status or "", r.problem) for r in states.run_changes(runs, asked, parts, solutions).collect())
    assert got == [(1, "completed", "no single reference solution"), (2, "", None), (2, "completed", "invalid transition"), (2, "running", None), (3, "failed", "unknown run")]
    assert states.run_changes(runs, asked.where("run_id = 1"), parts, solutions.where("role = 'reference'")).first().problem is None
    assert states.run_changes(runs, asked.limit(0), parts, solutions).count() == 0
    with pytest.raises(Exception, match="no such value"):
        states.renamed(asked, "status", {"completed": "odd"}, ("running",)).collect()
    order = {"name": F.col("name"), "created": F.col("created")}
    row = spark.createDataFrame([("b", "a")], "name string, created string")
    assert row.select(states.sort_column(F.lit("other"), order, "created").alias("c")).first().c == "a"


def test_order_repeats_and_hashes(spark):
    rows = spark.createDataFrame([("b",), ("A",), ("a",), (None,)], "name string")
    assert [r.name for r in problems.sorted_by_name(rows.where("name IS NOT NULL"), "name").collect()] == ["a", "A", "b"]
    assert problems.without_repeats(rows.where("name < 'b'"), "name").count() == 2
    with pytest.raises(Exception, match="repeated key: b"):
        problems.without_repeats(rows.unionByName(rows), "name").where("name = 'b'").collect()
    h = lambda df: problems.content_hash(df, ["name"]).first().content_sha256
    assert h(rows) == h(rows.orderBy("name").repartition(3)) and len({h(rows), h(rows.unionByName(rows)), h(rows.limit(0)), h(rows.where("name = 'a'"))}) == 4
    with pytest.raises(Exception, match="not one source"):
        problems.backfilled(spark.createDataFrame([(1, "x", 1)], "task_id long, status string, created long"), spark.createDataFrame([(1,), (2,)], "source_id long")).collect()


def test_admissions(spark):
    schema = "id string, planning_units long, primary long, auxiliary long, rows long, nonzeros long, feature_nonzeros long"
    rows = [("ok", 10, 8, 2, 5, 20, 30), ("counted", 10, None, None, None, None, None), ("minus", 10, 8, -1, 5, 20, 30), ("more", 3, 8, 0, 1, 1, 1), ("peak", 10**8, 10**8, 10**8, 10**8, 10**9, 1), ("scratch", 10, 10, 0, 1, 1, 10**10)]
    got = {r.id: r for r in contracts.admissions(spark.createDataFrame(rows, schema)).collect()}
    assert {k: r.reason for k, r in got.items()} == {"ok": "admitted", "counted": "structural_inventory_required", "minus": "negative dimension", "more": "more variables than units", "peak": "profile_peak_memory_exceeded", "scratch": "profile_scratch_space_exceeded"}
    compiler, solver = 10 * 25 + 6 * 8 + 20 * 12 + 5 * 16, 10 * 37 + 6 * 8 + 20 * 12 + 5 * 16
    assert (got["ok"].compiler_bytes, got["ok"].solver_bytes, got["ok"].scratch_bytes, got["ok"].peak_bytes) == (compiler, solver, 360 + compiler, int(1.5 * (compiler + solver)))
    assert got["ok"].peak_bytes == contracts.footprint(10, 5, 20)


def test_settings_and_entries_keep_what_they_are(spark):
    cases = {"1e-12": None, "1.2e3": 1200, "12.50": None, "1250e-1": 125, "-7.0": -7, " 3 ": 3, "0e99999": 0, "9223372036854775807": 9223372036854775807, "9223372036854775808": None, "1e99": None, ".": None, "": None, "+.5e1": 5, "000": 0, "1e": None, "00100e-2": 1}
    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", scalars.integer_setting(F.col("s")).alias("n")).collect()
    assert {r.s: r.n for r in got} == cases
    s = lambda x: F.lit(x).cast("string")
    before = s('{"k":3,"o":{"a":[1,"x",null],"b":{"c":true}},"t":"3"}')
    r = one(spark, scalars.with_entry(before, "n", F.lit(1.5)).alias("number"), scalars.with_entry(before, ("o", "b", "c"), s("no")).alias("deep"), scalars.with_entry(before, ("o", "b", "d"), F.lit(7)).alias("new"), scalars.with_entry(before, ("x", "y"), F.lit(1)).alias("missing"), scalars.with_entry(before, ("k", "y"), F.lit(1)).alias("scalar"), scalars.with_entry(before, "k", F.lit(None)).alias("null"))
    whole = {"k": 3, "o": {"a": [1, "x", None], "b": {"c": True}}, "t": "3"}
    assert json.loads(r.number) == whole | {"n": 1.5} and json.loads(r.missing) == whole == json.loads(r.scalar) and json.loads(r.null) == whole | {"k": None}
    assert json.loads(r.deep)["o"] == {"a": [1, "x", None], "b": {"c": "no"}} and json.loads(r.new)["o"]["b"] == {"c": True, "d": 7}
    assert one(spark, scalars.seed_colour(s("a😀")).alias("c")).c == "#796e8a"


def test_problem_violations_send_no_table_whole(spark):
    """Contracts and objectives grow with the problems: however small they are here, no task holds them all."""
    o = spark.range(40).select((F.col("id") % 9).alias("problem_id"), F.concat(F.lit("l"), F.col("id") % 5).alias("layer"), F.lit("maximize").alias("direction"), F.lit(1.0).alias("importance"))
    c = spark.range(10).select(F.col("id").alias("problem_id"), F.lit("aggregate").alias("type"), F.lit("l0").alias("layer"), F.lit(1.0).alias("low"), F.lit(2.0).alias("high"))
    k = spark.range(40).select((F.col("id") % 10).alias("problem_id"), F.concat(F.lit("l"), F.floor(F.col("id") / 10)).alias("layer"))
    got = problems.problem_violations(o, c, k)
    found = {(r.problem_id, r.layer, r.problem) for r in got.collect()}
    assert {x for x in found if x[2] == "no contract"} == {(n % 9, "l4", "no contract") for n in range(40) if n % 5 == 4} and (9, None, "no objective") in found
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
