import random

from terrane.functions.shared import save
from terrane.operators import graph


def brute_force(units, strength):
    """States after all rounds, and the number of rounds with the last, which changes nothing."""
    place = {(row, col): unit for unit, row, col, _, _ in units}
    state = {u[0]: u[4] for u in units}
    rounds = 0
    while True:
        rounds += 1
        out = []
        for unit, row, col, objective, _ in units:
            near = [place[p] for p in ((row, col + 1), (row, col - 1), (row + 1, col), (row - 1, col)) if p in place]
            if state[unit] == -1 and objective + strength * sum(state[n] != 0 for n in near) <= 1e-12:
                out.append(unit)
        if not out:
            return state, rounds
        state |= dict.fromkeys(out, 0)


def test_fixpoint_of_a_long_chain_as_brute_force(spark):
    r = random.Random(3)
    units = [(c, 0, c, -0.25 if c < 57 else 1.0, -1) for c in range(58)]
    units += [(100 + 9 * row + col, 10 + row, col, r.choice((-1.0, -0.75, -0.5, -0.25, 0.0, 0.5)), r.choice((-1, -1, -1, 0, 1))) for row in range(9) for col in range(9)]
    want, rounds = brute_force(units, 0.25)
    assert rounds == 58 and sum(want[c] == 0 for c in range(58)) == 57
    frame = spark.createDataFrame(units, "unit long, row long, col long, objective double, state int")
    got, n = graph.reduce_fixpoint(frame.select("unit", "objective", "state"), graph.rook_edges(frame), 0.25, save)
    assert n == rounds and {u.unit: u.state for u in got.collect()} == want


def test_units_that_bounds_need_stay_flexible(spark):
    units = spark.createDataFrame([(k, 0, k, -5.0, -1) for k in range(8)] + [(8, 0, 8, -0.25, -1)], "unit long, row long, col long, objective double, state int")
    rows = spark.createDataFrame([(1, 1.0, None), (2, None, 4.0), (3, None, None), (4, float("-inf"), float("nan"))], "row_id long, low double, high double")
    coefs = [(1, 0, 2.0), (1, 1, -2.0), (2, 2, 1.0), (2, 3, -1.0), (1, 3, 1.0), (3, 4, 1.0), (3, 5, -1.0), (4, 6, 1.0), (4, 7, -1.0), (1, 8, 0.0), (9, 7, 1.0)]
    kept = graph.protected(spark.createDataFrame(coefs, "row_id long, unit long, coef double"), rows)
    assert sorted(r.unit for r in kept.collect()) == [0, 3]
    once = graph.reduce_once(units.select("unit", "objective", "state"), graph.rook_edges(units), 0.25, kept)
    assert {r.unit for r in once.where("state = -1").collect()} == {0, 3}
    got, _ = graph.reduce_fixpoint(units.select("unit", "objective", "state"), graph.rook_edges(units), 0.25, save, kept)
    assert {r.unit for r in got.where("state = -1").collect()} == {0, 3} and got.count() == 9


def test_blocks_exchange_only_what_changed(spark, monkeypatch):
    """A chain of 2,000 units that falls one a round, back and forth over blocks, as one block finds it; few rows are written."""
    written = []

    def counted(df):
        written.append(save(df).count())
        return save(df)

    units = spark.createDataFrame([(c, 0, c, -0.25 if c < 1999 else 1.0, -1) for c in range(2000)], "unit long, row long, col long, objective double, state int")
    flat, edges = units.select("unit", "objective", "state"), graph.rook_edges(units)
    monkeypatch.setattr(graph, "BLOCK", 500)
    got, n = graph.reduce_fixpoint(flat, edges, 0.25, counted)
    assert n == 2000 and got.where("state = 0").count() == 1999 and sum(written) < 3 * 2000


def test_any_blocks_give_the_same(spark, monkeypatch):
    r = random.Random(8)
    units = [(9 * row + col, row, col, r.choice((-1.0, -0.75, -0.5, -0.25, 0.0, 0.5)), r.choice((-1, -1, -1, -1, 0, 1))) for row in range(9) for col in range(9)]
    want, rounds = brute_force(units, 0.25)
    frame = spark.createDataFrame(units, "unit long, row long, col long, objective double, state int")
    for block in (4, 27):
        monkeypatch.setattr(graph, "BLOCK", block)
        got, n = graph.reduce_fixpoint(frame.select("unit", "objective", "state"), graph.rook_edges(frame), 0.25, save)
        assert n == rounds and {u.unit: u.state for u in got.collect()} == want
    none, n = graph.reduce_fixpoint(frame.select("unit", "objective", "state").limit(0), graph.rook_edges(frame), 0.25, save)
    assert none.count() == 0 and n == 1
