import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from terrane.operators import linear

UNITS, ROWS, NONZEROS = "unit long, objective double, low double, high double", "row_id string, low double, high double", "row_id string, unit long, coef double"


def tables(spark, objective, rows, first=0, low=None, high=None):
    """rows: {name: (coefs, low, high)}"""
    low, high = low or [0.0] * len(objective), high or [1.0] * len(objective)
    units = spark.createDataFrame([(first + k, float(c), low[k], high[k]) for k, c in enumerate(objective)], UNITS)
    bounds = spark.createDataFrame([(n, a, b) for n, (_, a, b) in rows.items()], ROWS)
    return units, bounds, spark.createDataFrame([(n, first + k, float(v)) for n, (c, _, _) in rows.items() for k, v in enumerate(c)], NONZEROS)


def corners(c, a, low, high):
    """Best objective by trying all corners: as many bounds of rows hold as units lie between theirs."""
    n, best = len(c), None
    for free in (f for k in range(min(n, len(a)) + 1) for f in itertools.combinations(range(n), k)):
        rest = [j for j in range(n) if j not in free]
        for at in itertools.product((0.0, 1.0), repeat=len(rest)):
            x = np.zeros(n)
            x[rest] = at
            for rows in itertools.combinations(range(len(a)), len(free)):
                for side in itertools.product((low, high), repeat=len(free)):
                    if free:
                        want = np.array([s[r] for s, r in zip(side, rows)])
                        if not np.isfinite(want).all() or abs(np.linalg.det(a[np.ix_(rows, free)])) < 1e-9:
                            continue
                        x[list(free)] = np.linalg.solve(a[np.ix_(rows, free)], want - a[np.ix_(rows, rest)] @ np.array(at))
                    act = a @ x
                    if (x > -1e-9).all() and (x < 1 + 1e-9).all() and (act > low - 1e-9).all() and (act < high + 1e-9).all():
                        best = max(best if best is not None else -np.inf, c @ x)
    return best


def test_programs_as_all_corners(spark):
    r = np.random.default_rng(2)
    for n in (4, 6, 7):
        c, a = r.integers(-4, 9, n) / 4, r.integers(-2, 5, (2, n)).astype(float)
        low, high = np.array([-np.inf, 2.0]), np.array([5.0, np.inf])
        want = corners(c, a, low, high)
        p = linear.program(*tables(spark, c, {"a": (a[0], None, 5.0), "b": (a[1], 2.0, float("nan"))}))
        got = linear.solve(p)[0]
        assert (want is None) == (got.status == "infeasible")
        if want is not None:
            assert got.status == "optimal" and abs(got.objective - want) < 1e-6 and abs(got.bound - want) < 1e-6
            x = np.array([q.x for q in linear.allocations(p, got).orderBy("unit").collect()])
            assert abs(c @ x - want) < 1e-6 and (a @ x <= high + 1e-6).all() and (a @ x >= low - 1e-6).all()


def test_fixed_fractional_and_empty(spark):
    p = linear.program(*tables(spark, [1, 0.5], {"sum": ([1, 1], None, 1.5)}))
    assert [q.x for q in linear.allocations(p, linear.solve(p)[0]).orderBy("unit").collect()] == pytest.approx([1, 0.5], abs=1e-6)
    p = linear.program(*tables(spark, [1, 2, 3], {}, low=[0.5, 0.0, 0.0], high=[1.0, 0.25, 0.0]))
    assert linear.solve(p)[0].objective == pytest.approx(1.5)
    p = linear.program(*(t.limit(0) for t in tables(spark, [1], {"a": ([1], 0.0, 1.0)})))
    assert linear.solve(p)[0].objective == 0 and linear.allocations(p, linear.solve(p)[0]).count() == 0


def test_priority_over_nested_budgets(spark):
    got = linear.priority(*tables(spark, [3, 2, 1], {}), [1 / 3, 2 / 3, 1]).orderBy("unit").collect()
    assert [r.priority for r in got] == pytest.approx([1, 2 / 3, 1 / 3], abs=1e-6)
    with pytest.raises(ValueError, match="infeasible"):
        linear.priority(*tables(spark, [1, 0.5], {"area": ([1, 1], None, 1.5)}), [1.0])
    with pytest.raises(ValueError, match="rise"):
        linear.priority(*tables(spark, [1], {}), [0.5, 0.5])


def test_priority_with_two_rows(spark):
    """The smallest budget takes unit 0; row a then keeps 1 out, row b asks for a half of 3; the largest budget holds all that before."""
    rows = {"a": ([4, 3, 1, 1], None, 6.0), "b": ([0, 0, 0, 1], 0.5, None)}
    got = linear.priority(*tables(spark, [9, 8, 2, 1], rows), [0.375, 0.75]).orderBy("unit").collect()
    # 1.5 units: x3 = .5 (b), x0 = 1; 3 units: x0 = 1, x3 >= .5, and 4 + 3 x1 + x2 + x3 <= 6 leaves x1 = 0
    assert np.array([r.given for r in got]) == pytest.approx(np.array([[1, 1], [0, 0], [0, 1], [0.5, 1]]), abs=1e-4)
    assert [r.priority for r in got] == pytest.approx([1, 0, 0.5, 0.75], abs=1e-4)


CASES = [
    ([3, 2, 1], 1, None, {100: 1, 101: 0, 102: 0}),
    ([2, 2], 1, None, {100: 0, 101: 0}),
    ([5, 3, 3], 2, 6.0, {100: 2, 102: 0}),
    ([5, 4, 1], 2, None, {100: 4, 101: 3}),
    ([2, 0], 1, 2.0, {100: None}),
]


@pytest.mark.parametrize("values,cap,least,want", CASES)
def test_replacement(spark, values, cap, least, want):
    rows = {"cap": ([1] * len(values), None, float(cap))} | ({"habitat": (values, least, None)} if least else {})
    asked = spark.createDataFrame([(u,) for u in want], "unit long")
    got = {r.unit: r for r in linear.replacement(*tables(spark, values, rows, 100), asked).collect()}
    assert set(got) == set(want)
    for u, loss in want.items():
        assert got[u].status == ("absolutely_irreplaceable" if loss is None else "replaceable")
        assert got[u].loss is None if loss is None else got[u].loss == pytest.approx(loss, abs=1e-6)


def test_replacement_refuses_too_many_and_unmeetable(spark):
    with pytest.raises(ValueError, match="more than 2"):
        linear.replacement(*tables(spark, [3, 2, 1], {}), most=2)
    with pytest.raises(ValueError, match="infeasible"):
        linear.replacement(*tables(spark, [3], {"a": ([1], 2.0, None)}))


def test_many_units_close_the_gap(spark):
    units = spark.range(20000).select(F.col("id").alias("unit"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("objective"))
    entries = units.select(F.explode(F.array(*(F.struct(F.lit(f"r{k}").alias("row_id"), (F.pmod(F.xxhash64("unit", F.lit(k)), F.lit(100)) / 10).alias("coef")) for k in range(3)))).alias("e"), "unit").select("e.row_id", "unit", "e.coef")
    rows = spark.createDataFrame([("r0", None, 20000.0), ("r1", 30000.0, 35000.0), ("r2", None, 30000.0)], ROWS)
    found = linear.solve(linear.program(units, rows, entries))[0]
    assert found.status == "optimal" and abs(found.bound - found.objective) < 1e-4 and found.activity[0] < 20000.01


def test_replacements_are_solved_among_near_units(spark, monkeypatch):
    """As each solved over all units, which only those need whose prices move too far."""
    r = np.random.default_rng(5)
    n = 300
    value, a, b = r.integers(1, 60, n).astype(float), r.integers(1, 9, n).astype(float), r.integers(0, 5, n).astype(float)
    frames = tables(spark, value.tolist(), {"a": (a.tolist(), None, 300.0), "b": (b.tolist(), None, 110.0)})
    p = linear.program(*frames)
    best, ids = linear.solve(p)[0], [u.unit for u in frames[0].select("unit").orderBy("unit").collect()]
    some = ids[::9]
    want = {u: best.bound - s.bound for u, s in zip(some, linear.solve(p, [{u: (0.0, 0.0)} for u in some], best.prices), strict=True)}
    calls, solve = [], linear.solve
    monkeypatch.setattr(linear, "solve", lambda p, scenarios=({},), *rest: calls.append(len(scenarios)) or solve(p, scenarios, *rest))
    monkeypatch.setattr(linear, "NEAR", 40)
    got = {u.unit: u for u in linear.replacement(*frames, most=None).collect()}
    assert set(got) == set(ids) and sum(u.loss > 1 for u in got.values()) > 60
    assert {u: got[u].loss for u in some} == pytest.approx(want, abs=1e-6)
    assert calls[0] == 1 and sum(calls[1:]) < 10
    # too few near units for anything: all are solved over all units, with the same losses
    monkeypatch.setattr(linear, "NEAR", 1)
    asked = spark.createDataFrame([(u,) for u in some], frames[0].select("unit").schema)
    assert {u.unit: u.loss for u in linear.replacement(*frames, asked).collect()} == pytest.approx(want, abs=1e-6)
