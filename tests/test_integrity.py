import hashlib
import random

import pytest
from pyspark.sql import functions as F
from terrane.operators import integrity


def test_root_is_of_the_content_alone(spark, monkeypatch):
    monkeypatch.setattr(integrity, "FAN", 7)
    r = random.Random(1)
    rows = [(r.randrange(50), r.choice((None, "", "a", "1:a", "n")), r.random()) for _ in range(400)] + [(1, "a", 0.5)] * 20
    frame = lambda rows, n: spark.createDataFrame(rows, "k long, s string, v double").repartition(n)
    root = integrity.merkle_root(frame(rows, 1), ["k", "s", "v"])
    r.shuffle(rows)
    assert root == integrity.merkle_root(frame(rows, 5), ["k", "s", "v"])
    other = [*rows[:200], (rows[200][0], rows[200][1], rows[200][2] + 1e-15), *rows[201:]]
    assert root != integrity.merkle_root(frame(other, 5), ["k", "s", "v"]) and root != integrity.merkle_root(frame(rows[1:], 3), ["k", "s", "v"])
    # two values that change places, and values that run into each other
    assert integrity.merkle_root(frame([(1, "x", 1.0), (2, "y", 2.0)], 1), ["k", "s", "v"]) != integrity.merkle_root(frame([(1, "y", 1.0), (2, "x", 2.0)], 1), ["k", "s", "v"])
    two = lambda a, b: integrity.merkle_root(spark.createDataFrame([(a, b)], "a string, b string"), ["a", "b"])
    assert len({two("a1:", "b"), two("a", "1:b"), two(None, "b"), two("n", "b"), two("", "b"), two("b", None)}) == 6
    assert integrity.merkle_root(frame([], 1), ["k"]) == integrity.merkle_root(frame([], 4), ["k"])
    tables = {"rows": (frame(rows, 2), ["k", "s", "v"])}
    assert len({integrity.model_hash(tables), integrity.model_hash(tables, False), integrity.model_hash(tables, True, 1.0), integrity.model_hash({"cols": tables["rows"]})}) == 4


def test_root_of_a_fixed_height(spark, monkeypatch):
    """As the SQL of the query merkle_root: a hash over all nodes, also where they are more than one node may hold."""
    monkeypatch.setattr(integrity, "FAN", 7)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    node = lambda hashes: sha(f"node:{len(hashes)}:{''.join(hashes)}")
    for n in (3, 40, 400):
        leaves = [sha(t) for t in sorted(f"{len(str(k))}:{k}" for k in range(n))]
        want = sha("k;" + node([node(leaves[i : i + 7]) for i in range(0, n, 7)]))
        got = {levels: integrity.merkle_root(spark.range(n).select(F.col("id").alias("k")).repartition(3), ["k"], levels) for levels in (None, 2)}
        assert got[2] == want and (got[None] == want) == (n == 40)
    assert integrity.merkle_root(spark.range(0).withColumnRenamed("id", "k"), ["k"], 2) == integrity.merkle_root(spark.range(0).withColumnRenamed("id", "k"), ["k"])


def test_gaps_repeats_and_overlaps_over_ranges(spark):
    rows = [(k * 10, k * 10 + 10) for k in range(200)]
    rows.remove((50, 60))
    rows += [(70, 80), (1000, 1005), (1990, 1985), (None, 3), (400, None), (205, 900)]
    got = sorted(map(tuple, integrity.order_problems(spark.createDataFrame(rows, "a long, b long"), "a", "b", 0).collect()), key=repr)
    want, far, last = [], 0, None
    for a, b in sorted((x for x in rows if None not in x)):
        problem = "repeat" if (a, b) == last else "empty" if b <= a else "gap" if a > far else "overlap" if a < far else None
        if problem:
            want.append((a, b, far, problem))
        far, last = max(far, b), (a, b)
    found = [x for x in got if None not in x[:2]]
    assert found == sorted(want, key=repr) and {x[3] for x in found} == {"gap", "overlap", "repeat", "empty"}
    assert sorted(x[3] for x in got if None in x[:2]) == ["missing", "missing"]
    assert integrity.order_problems(spark.createDataFrame([(5, 6)], "a long, b long"), "a", "b", 0).first().problem == "gap"
    assert integrity.order_problems(spark.createDataFrame([(5, 6)], "a long, b long"), "a", "b").count() == 0


def test_values_that_do_not_rise(spark):
    values = [*range(100), 50, 51, 51, 60, 61]
    got = integrity.not_rising(spark.createDataFrame(list(enumerate(values)), "n long, v long"), "v", ["n"])
    assert sorted((r.n, r.v, r.before) for r in got.collect()) == [(100, 50, 99), (102, 51, 51)]


def test_scenarios_apply_nest_and_undo(spark):
    base = {"a": (0.0, 1.0), "b": (0.0, 5.0), "c": (None, 2.0)}
    scenarios = {"x": {"a": (0.5, 0.5)}, "y": {"a": (0.0, 0.0), "b": (1.0, 2.0)}, "z": {"c": (None, None)}}
    r = random.Random(12)
    log, stack, states = [], {}, {}
    for session in ("s", "t"):
        stack[session] = []
        for n in range(1, 15):
            op = r.choice(("x", "y", "z", None, None))
            log.append((session, n, op))
            if op:
                stack[session].append(op)
            elif stack[session]:
                stack[session].pop()
            bounds = dict(base)
            for s in stack[session]:
                bounds |= scenarios[s]
            states[session, n] = bounds
    make = spark.createDataFrame
    frames = make([(k, *v) for k, v in base.items()], "key string, low double, high double"), make([(s, k, *v) for s, o in scenarios.items() for k, v in o.items()], "scenario string, key string, low double, high double"), make(log, "session string, seq long, scenario string")
    moments = make([(s, n) for s in "st" for n in range(0, 15)], "session string, at long")
    named = {s: {k for x in {op for q, _, op in log if q == s and op} for k in scenarios[x]} for s in "st"}
    got = {(x.session, x["at"], x.key): (x.low, x.high) for x in integrity.bounds_at(*frames, moments).collect()}
    assert got == {(s, n, k): states.get((s, n), base)[k] for s in "st" for n in range(0, 15) for k in named[s]}
    with pytest.raises(Exception, match="bad override of d"):
        integrity.bound_versions(frames[0], make([("x", "d", 0.0, 1.0)], frames[1].schema), frames[2]).collect()
    with pytest.raises(Exception, match="bad override of a"):
        integrity.bound_versions(frames[0], make([("x", "a", 2.0, 1.0)], frames[1].schema), frames[2]).collect()
