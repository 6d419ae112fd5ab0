"""Rook neighbours: edges, their kinds, pair values, degrees, and the reduction of units that neighbours decide.

States: NULL or -1 flexible, 0 fixed out, 1 fixed in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators.grid import numbered


def rook_edges(units: DataFrame, key: str = "unit") -> DataFrame:
    """a, b: each undirected edge once, to the right and down. Two equi joins; one join on either would be a nested loop."""
    here = units.select("row", "col", F.col(key).alias("a"))
    there = units.select("row", "col", F.col(key).alias("b"))
    right = here.join(there.withColumn("col", F.col("col") - 1), ["row", "col"])
    down = here.join(there.withColumn("row", F.col("row") - 1), ["row", "col"])
    return right.select("a", "b").unionByName(down.select("a", "b"))


def with_states(edges: DataFrame, states: DataFrame, columns: list[str]) -> DataFrame:
    """Edges with columns of both ends, suffixed _a and _b."""
    for end in ("a", "b"):
        edges = edges.join(states.select(F.col("unit").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)), end)
    return edges


def classify(edges: DataFrame) -> DataFrame:
    """Counts of edges by the states of their ends, in one aggregate."""
    a, b = F.coalesce("state_a", F.lit(-1)), F.coalesce("state_b", F.lit(-1))
    one_free = (a == -1) != (b == -1)
    return edges.agg(
        F.count("*").alias("raw"),
        F.count_if((a != -1) & (b != -1)).alias("constant"),
        F.count_if((a == 1) & (b == 1)).alias("constant_selected"),
        F.count_if(one_free).alias("unary"),
        F.count_if(one_free & (F.greatest(a, b) == 0)).alias("fixed0_unary"),
        F.count_if(one_free & (F.greatest(a, b) == 1)).alias("fixed1_unary"),
        F.count_if((a == -1) & (b == -1)).alias("pairwise"),
    )


def pair_value(edges: DataFrame, continuous: bool) -> DataFrame:
    """Value of selected pairs: both at least a half (discrete), or the sum of the lesser allocations (continuous)."""
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))
    value = F.sum(F.least(clip("x_a"), clip("x_b"))) if continuous else F.sum(((F.col("x_a") >= 0.5) & (F.col("x_b") >= 0.5)).cast("double"))
    return edges.agg(F.coalesce(value, F.lit(0.0)).alias("pair_value"))


def degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("unit")).unionByName(edges.select(F.col("b").alias("unit")))
    return both.groupBy("unit").agg(F.count("*").alias("degree"))


def neighbour_counts(edges: DataFrame, states: DataFrame) -> DataFrame:
    """unit, flexible, selected, degree: how many neighbours are flexible, fixed in, and there at all."""
    both = edges.select(F.col("a").alias("unit"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("unit"), F.col("a").alias("other")))
    rows = both.join(states.select(F.col("unit").alias("other"), F.coalesce("state", F.lit(-1)).alias("state")), "other")
    return rows.groupBy("unit").agg(F.count_if(F.col("state") == -1).alias("flexible"), F.count_if(F.col("state") == 1).alias("selected"), F.count("*").alias("degree"))


def protected(nonzeros: DataFrame, rows: DataFrame) -> DataFrame:
    """unit: those that a bound may need: a positive coefficient in a row with a finite lower bound, or a negative one in
    a row with a finite upper bound. nonzeros: row_id, unit, coef. rows: row_id, low, high."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    needed = (F.col("coef") > 0) & finite("low") | (F.col("coef") < 0) & finite("high")
    return nonzeros.join(rows.select("row_id", F.col("low").cast("double"), F.col("high").cast("double")), "row_id").where(needed).select("unit").distinct()


def reduce_once(units: DataFrame, edges: DataFrame, strength: float, kept: DataFrame | None = None) -> DataFrame:
    """One round: a flexible unit goes out for sure if its objective plus all it could gain from neighbours that are not
    out stays at or below nought. Units of kept (unit: see protected) stay flexible."""
    both = edges.select(F.col("a").alias("unit"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("unit"), F.col("a").alias("other")))
    gain = both.join(units.where("state <> 0").select(F.col("unit").alias("other")), "other").groupBy("unit").agg(F.count("*").alias("open"))
    rows = units.join(gain, "unit", "left").withColumn("open", F.coalesce("open", F.lit(0)))
    out = (F.col("state") == -1) & (F.col("objective") + strength * F.col("open") <= 1e-12)
    if kept is None:
        return rows.withColumn("state", F.when(out, 0).otherwise(F.col("state"))).drop("open")
    gone = rows.where(out).select("unit").join(kept, "unit", "left_anti").withColumn("gone", F.lit(True))
    return rows.join(gone, "unit", "left").withColumn("state", F.when(F.col("gone"), 0).otherwise(F.col("state"))).drop("open", "gone")


#: Units of a block: a block and its edges are one row of a table, and one task's work at a time.
BLOCK = 1 << 14


def _falls(block: dict, strength: float, outside: dict[int, int]) -> dict[int, int]:
    """Round in which each unit of a block goes out (0: it was out before), given the rounds of units outside it.

    A unit goes in the round after the last neighbour whose loss it can't bear, so units are settled in order of rounds.
    """
    near: dict[int, list[int]] = {}
    touched: dict[int, list[int]] = {}
    for a, b in zip(block["a"], block["b"], strict=True):
        near.setdefault(a, []).append(b)
        touched.setdefault(b, []).append(a)
    start = {u: s for u, s in zip(block["unit"], block["state"], strict=True)}
    left, found, rounds = {}, {}, {}
    for u, s, objective, kept in zip(block["unit"], block["state"], block["objective"], block["kept"], strict=True):
        if s == 0:
            found[u] = 0
        if s != -1 or kept or objective is None:
            continue
        # a neighbour outside, or one that is open inside, is one that may still go
        n = sum(start[v] is not None and start[v] != 0 if v in start else True for v in near.get(u, ()))
        need = next((r for r in range(n + 1) if objective + strength * (n - r) <= 1e-12), None)
        if need == 0:
            rounds.setdefault(1, []).append(u)
            found[u] = 1
        elif need is not None:
            left[u] = need
    for v, k in outside.items():
        rounds.setdefault(k, []).append(v)
    while rounds:
        k = min(rounds)
        for v in rounds.pop(k):
            for u in touched.get(v, ()):
                if u in left and start.get(v, -1) != 0:
                    left[u] -= 1
                    if not left[u]:
                        del left[u]
                        found[u] = k + 1
                        rounds.setdefault(k + 1, []).append(u)
    return found


def reduce_fixpoint(units: DataFrame, edges: DataFrame, strength: float, save, kept: DataFrame | None = None) -> tuple[DataFrame, int]:
    """reduce_once() until nothing changes, however many rounds that takes. Returns the units and the rounds.

    Units are cut into blocks by id. A block works out all its rounds at once, given those of its neighbours outside; what
    it finds goes to the blocks that border on it, and only blocks that hear of an earlier round than before are worked
    out again. So chains within blocks cost one pass, and later passes read only what changed. save(df) writes a table to
    shared storage. Ids are whole numbers; strength isn't negative. Units of kept stay flexible.
    """
    spark = units.sparkSession
    rows = units.select(F.col("unit").cast("long").alias("unit"), F.col("state").cast("int").alias("state"), F.col("objective").cast("double").alias("objective"))
    if kept is None:
        rows = rows.withColumn("kept", F.lit(False))
    else:
        rows = rows.join(kept.select(F.col("unit").cast("long").alias("unit"), F.lit(True).alias("kept")).distinct(), "unit", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    rows = save(numbered(rows, [F.asc("unit")], "n").withColumn("block", F.floor(F.col("n") / BLOCK)).drop("n"))
    both = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = rows.select(F.col("unit").alias("a"), F.col("block"), F.col("state").alias("state_a"))
    others = rows.select(F.col("unit").alias("b"), F.col("block").alias("to"), F.col("state").alias("state_b"))
    # of edges into another block those count that may matter to a: neither end is out from the start
    known = both.join(ends, "a").join(others, "b").where(F.col("block").eqNullSafe(F.col("to")) | (F.coalesce("state_b", F.lit(0)) != 0))
    lists = known.groupBy("block").agg(F.collect_list(F.struct("a", "b", "to")).alias("e"))
    blocks = rows.groupBy("block").agg(F.collect_list(F.struct("unit", "state", "objective", "kept")).alias("u")).join(lists, "block", "left")
    none = F.array().cast("array<long>")
    blocks = save(blocks.select("block", *(f"u.{c}" for c in ("unit", "state", "objective", "kept")), *(F.coalesce(f"e.{c}", none).alias(c) for c in ("a", "b", "to"))))

    def run(whole: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for block in batch.to_pylist():
                    found = _falls(block, strength, {x["unit"]: x["round"] for x in block["heard"] or ()})
                    if whole:
                        out += [(block["block"], u, k) for u, k in found.items()]
                    else:
                        sent = {(to, a) for a, to in zip(block["a"], block["to"], strict=True) if to != block["block"] and found.get(a, 0) > 0}
                        out += [(to, a, found[a]) for to, a in sent]
                columns = list(zip(*out, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["block", "unit", "round"])

        return work

    schema, heard = "block long, unit long, round long", None
    while True:
        if heard is None:
            news = save(blocks.withColumn("heard", F.lit(None).cast("array<struct<unit: long, round: long>>")).mapInArrow(run(False), schema))
        else:  # only blocks that heard something new, with all they have heard
            active = news.select("block").distinct()
            grouped = heard.join(active, "block", "left_semi").groupBy("block").agg(F.collect_list(F.struct("unit", "round")).alias("heard"))
            sent = blocks.join(grouped, "block").mapInArrow(run(False), schema)
            news = save(sent.join(heard.withColumnRenamed("round", "before"), ["block", "unit"], "left").where("before IS NULL OR round < before").select("block", "unit", "round"))
        if news.isEmpty():
            break
        heard = news if heard is None else save(heard.unionByName(news).groupBy("block", "unit").agg(F.min("round").alias("round")))
    if heard is None:
        heard = spark.createDataFrame([], schema)
    grouped = heard.groupBy("block").agg(F.collect_list(F.struct("unit", "round")).alias("heard"))
    falls = save(blocks.join(grouped, "block", "left").mapInArrow(run(True), schema))
    out = falls.select(F.col("unit"), F.lit(0).alias("fallen"))
    states = units.join(out, "unit", "left").withColumn("state", F.coalesce("fallen", "state")).select(*units.columns)
    last = falls.agg(F.coalesce(F.max("round"), F.lit(0))).first()[0]
    return states, last + 1
