import random

import pytest
from terrane.operators import selection

from tests.test_linear import tables


def knapsack(units, budget):
    """Best value between 0 and 1, densest first."""
    worth = 0.0
    for _, v, c in sorted((u for u in units if u[1] > 0), key=lambda u: (-(u[1] / u[2] if u[2] else float("inf")), u[0])):
        x = 1.0 if c <= 0 else min(1.0, budget / c)
        worth, budget = worth + x * v, budget - x * c
    return worth


@pytest.mark.parametrize("budget", [0.0, 7.0, 30.5, 1e6])
def test_exclusions_as_solved_one_by_one(spark, budget):
    r = random.Random(6)
    units = [(k, float(r.randrange(-2, 9)), float(r.choice((0, 1, 1, 2, 3, 5)))) for k in range(40)]
    got = {u.unit: u for u in selection.exclusions(spark.createDataFrame([(*u, 1) for u in units], "unit long, objective double, cost double, x int"), budget).collect()}
    best = knapsack(units, budget)
    assert len(got) == 40 and sum(got[k].x * v for k, v, _ in units) == pytest.approx(best)
    for u in units:
        assert got[u[0]].loss == pytest.approx(best - knapsack([o for o in units if o != u], budget)), u


def test_as_of_over_ranges(spark):
    points = [(float(k // 2), k, f"v{k}") for k in range(50)]
    probes = [(k, k * 0.7 - 3) for k in range(60)]
    got = selection.as_of(spark.createDataFrame(points, "at double, n long, v string"), spark.createDataFrame(probes, "id long, at double"), "at", ["n"])
    for r in got.collect():
        want = [p for p in points if p[0] <= r["at"]]
        assert (r.what and r.what.v) == (want[-1][2] if want else None)


def test_warm_start_of_one_and_two_rows(spark):
    got = selection.warm_start(*tables(spark, [0.9, 0.8, 0.2], {"cost": ([4, 3, 1], None, 5.0)}))
    x = [r.x for r in got.orderBy("unit").collect()]
    assert sum(a * b for a, b in zip(x, [4, 3, 1])) <= 5 and sum(a * b for a, b in zip(x, [0.9, 0.8, 0.2])) >= 1.0 - 1e-9
    two = {"cost": ([4, 3, 1], None, 5.0), "area": ([1, 1, 1], None, 1.0)}
    assert [r.x for r in selection.warm_start(*tables(spark, [0.9, 0.8, 0.2], two)).orderBy("unit").collect()] == [1, 0, 0]
    # a negative unit stays out, and no row is broken
    assert [r.x for r in selection.warm_start(*tables(spark, [0.9, -0.5, 0.2], {"a": ([0, 1, 0], 0.0, None)})).orderBy("unit").collect()] == [1, 0, 1]


def test_warm_start_meets_a_lower_bound_or_finds_none(spark):
    rows = {"cost": ([1, 1, 1], None, 2.0), "habitat": ([0, 0, 1], 1.0, None)}
    assert [r.x for r in selection.warm_start(*tables(spark, [3, 2, 1], rows)).orderBy("unit").collect()] == [1, 0, 1]
    assert selection.warm_start(*tables(spark, [3, 2], {"cost": ([1, 1], None, 1.0), "both": ([1, 1], 2.0, None)})) is None


def test_warm_start_sends_no_table_of_units_whole(spark, monkeypatch):
    kind, plans = type(spark.range(1)), []
    join = kind.join

    def spied(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if on == "unit":
            plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(kind, "join", spied)
    got = selection.warm_start(*tables(spark, [0.9, 0.8, 0.2], {"cost": ([4, 3, 1], None, 5.0)}))
    assert sum(r.x for r in got.collect()) >= 1 and len(plans) > 5
    assert not [p for p in plans if "BroadcastHashJoin [unit" in p]
