"""Whether tables are what they should be: hashes of their content, gaps in their order, bounds that scenarios changed.

No step gathers more than FAN rows of one table, unless a caller fixes the height of a tree: hashes go up a tree, ranges are
compared by their ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.shared import save
from terrane.operators.grid import numbered, ranged
from terrane.operators.selection import as_of

#: Hashes that one hash of the tree covers. Another number gives other roots.
FAN = 1024


def row_text(columns: Sequence[str]) -> Column:
    """A row as text that no other row has: each value with its length, NULL as n."""
    text = lambda c: F.col(c).cast("string")
    return F.concat(*(F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("n")) for c in columns))


def merkle_root(df: DataFrame, columns: Sequence[str], levels: int | None = None) -> str:
    """Root of the tree of SHA-256 hashes over the rows in order of columns, however they are partitioned.

    Equal tables have equal roots, also with repeated rows; any other value, row or order of columns gives another. Values
    are taken by their text, so 1 and 1.0 differ. Columns are of simple types. An empty table has the root of no rows.

    levels: so many levels above the rows, of which the last is one hash over all that the one before left; without it, as
    many as it takes. With 2, one task hashes the hashes of all nodes: 64 bytes for FAN rows, 64 MB for a thousand million.
    """
    text = df.select(row_text(columns).alias("t"))
    level = numbered(text, [F.asc("t")], "n").select("n", F.sha2("t", 256).alias("h"))
    done = 0
    while True:
        done += 1
        node = F.lit(0) if done == levels else F.floor(F.col("n") / FAN)
        groups = level.groupBy(node.cast("long").alias("n")).agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("x"), F.count("*").alias("k"))
        level = save(groups.select("n", F.sha2(F.concat_ws(":", F.lit("node"), F.col("k").cast("string"), F.array_join(F.col("x.h"), "")), 256).alias("h")))
        top = level.limit(2).collect()
        if done == levels or levels is None and len(top) < 2:
            head = ",".join(columns) + ";" + (top[0].h if top else "")
            return hashlib.sha256(head.encode()).hexdigest()


def model_hash(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], maximize: bool = True, offset: float = 0.0) -> str:
    """One hash of the tables of a model by their names (each with its columns), its sense and its offset."""
    parts = [f"{name}={merkle_root(df, columns)}" for name, (df, columns) in sorted(tables.items())]
    return hashlib.sha256("\n".join(["maximize" if maximize else "minimize", float(offset).hex(), *parts]).encode()).hexdigest()


def order_problems(df: DataFrame, start: str, stop: str, first: int | None = None) -> DataFrame:
    """start, stop, expected, problem of the rows of half-open ranges that don't follow on: gap, overlap, repeat (of the same
    range), empty (it ends before or where it starts) or missing (no start or no stop).

    Ranges are compared in order of start. Within a range of the sort each row meets the one before it; the first row of
    each meets the ends of all sort ranges before it, one row a range. first: where the first one must start.
    """
    a, b = F.col(start).cast("long"), F.col(stop).cast("long")
    rows = ranged(df.select(a.alias("start"), b.alias("stop")), [F.asc("start"), F.asc("stop")])
    inner = Window.partitionBy("p").orderBy("start", "stop")
    whole = F.col("start").isNotNull() & F.col("stop").isNotNull()
    ends = rows.where(whole).groupBy("p").agg(F.max("stop").alias("far"), F.max(F.struct("start", "stop")).alias("end"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.select("p").distinct().join(ends, "p", "left").select("p", F.max("far").over(before).alias("far"), F.last("end", True).over(before).alias("end"))
    upto = F.max(F.when(whole, F.col("stop"))).over(inner.rowsBetween(Window.unboundedPreceding, -1))
    last = F.last(F.when(whole, F.struct("start", "stop")), True).over(inner.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"upto": upto, "last": last}).join(F.broadcast(carried), "p")
    origin = F.lit(first).cast("long")
    rows = rows.withColumns({"expected": F.coalesce(F.greatest("upto", "far"), origin), "last": F.coalesce("last", "end")})
    problem = (
        F.when(~whole, "missing")
        .when(F.col("last") == F.struct("start", "stop"), "repeat")
        .when(F.col("stop") <= F.col("start"), "empty")
        .when(F.col("start") > F.col("expected"), "gap")
        .when(F.col("start") < F.col("expected"), "overlap")
    )
    return rows.select("start", "stop", "expected", problem.alias("problem")).where("problem IS NOT NULL")


def not_rising(df: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """order, value, before of the rows whose value isn't above that of the row before it, in this order of the whole table."""
    rows = ranged(df.select(*order, value), [F.asc(c) for c in order])
    lag = F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy("p").orderBy(*order))
    ends = rows.groupBy("p").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("end"))
    carried = ends.select("p", F.lag("end").over(Window.orderBy("p")).alias("end"))
    rows = rows.withColumn("before", lag).join(F.broadcast(carried), "p").withColumn("before", F.coalesce("before", "end"))
    return rows.where(F.col("before").isNotNull() & ~F.coalesce(F.col(value) > F.col("before.v"), F.lit(False))).select(*order, value, F.col("before.v").alias("before"))


def scenario_spans(log: DataFrame) -> DataFrame:
    """session, scenario, depth, since, until (NULL: still) of a log (session, seq, scenario): a scenario applies from its
    number on, on top of those before it; a NULL scenario undoes the last one that applies. Undoing nothing does nothing."""
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("scenario").isNotNull(), 1).otherwise(-1)
    # depth that may not fall below nought: the running sum less its least so far
    rows = log.withColumn("sum", F.sum(step).over(w))
    rows = rows.withColumn("depth", F.col("sum") - F.least(F.min("sum").over(w), F.lit(0)))
    level = F.when(F.col("scenario").isNotNull(), F.col("depth"))
    # it ends where an undo first leaves a depth below its own
    ends = rows.where(F.col("scenario").isNull()).select(F.col("session").alias("s"), F.col("seq").alias("end"), F.col("depth").alias("left"))
    starts = rows.where(F.col("scenario").isNotNull()).select("session", "scenario", level.alias("depth"), F.col("seq").alias("since"))
    found = starts.join(ends, (F.col("session") == F.col("s")) & (F.col("left") == F.col("depth") - 1) & (F.col("end") > F.col("since")), "left")
    return found.groupBy("session", "scenario", "depth", "since").agg(F.min("end").alias("until"))


def bound_versions(base: DataFrame, overrides: DataFrame, log: DataFrame) -> DataFrame:
    """session, key, since, low, high: from which number of the log on each key has which bounds, all back to the base's
    where no scenario that applies names it.

    base: key, low, high. overrides: scenario, key, low, high. An override of a key that base lacks, or with low above high, raises.
    """
    known = overrides.join(base.select("key", F.lit(True).alias("known")), "key", "left")
    text = F.concat(F.lit("bad override of "), F.col("key").cast("string"))
    bad = F.col("known").isNull() | F.coalesce(F.col("low") > F.col("high"), F.lit(False))
    checked = known.where(F.when(bad, F.raise_error(text).cast("boolean")).otherwise(F.lit(True))).drop("known")
    spans = save(scenario_spans(log).join(checked, "scenario").select("session", "key", "depth", "since", "until", "low", "high"))
    moments = spans.select("session", "key", F.explode(F.array_compact(F.array("since", "until"))).alias("at")).distinct()
    holds = (F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("until") > F.col("at")))
    top = moments.join(spans, ["session", "key"]).groupBy("session", "key", "at").agg(F.max_by(F.struct("low", "high"), F.when(holds, F.struct("depth", "since"))).alias("top"), F.max(holds).alias("any"))
    old = base.select("key", F.struct("low", "high").alias("old"))
    now = top.join(old, "key").select("session", "key", F.col("at").alias("since"), F.when(F.col("any"), F.col("top")).otherwise(F.col("old")).alias("b"))
    return now.select("session", "key", "since", "b.low", "b.high")


def bounds_at(base: DataFrame, overrides: DataFrame, log: DataFrame, moments: DataFrame) -> DataFrame:
    """session, at, key, low, high for moments (session, at): the bounds after that number of the session's log of the keys that
    a scenario of the session names at any time; all other keys have the base's. One as-of lookup in bound_versions()."""
    versions = save(bound_versions(base, overrides, log)).withColumn("place", F.struct("session", "key", F.col("since").alias("n")))
    wanted = moments.select("session", "at").distinct().join(versions.select("session", "key").distinct(), "session")
    found = as_of(versions, wanted.withColumn("place", F.struct("session", "key", F.col("at").alias("n"))), "place", ["since"])
    same = F.coalesce((F.col("what.session") == F.col("session")) & (F.col("what.key") == F.col("key")), F.lit(False))
    old = base.select("key", F.struct("low", "high").alias("old"))
    rows = found.join(old, "key").withColumn("b", F.when(same, F.struct(F.col("what.low").alias("low"), F.col("what.high").alias("high"))).otherwise(F.col("old")))
    return rows.select("session", "at", "key", "b.low", "b.high")
