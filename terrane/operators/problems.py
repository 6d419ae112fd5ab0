"""Problems and runs before they are compiled: what is wrong with a definition, how large it will get, what a result must show.

objectives: problem_id, layer, direction, importance. constraints: problem_id, type, layer, low, high. contracts:
problem_id, layer, native, evidence (cell sizes in metres). Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Settings that the options of a solve may not name.
RESERVED = ("time_limit", "mip_rel_gap", "mip_abs_gap", "threads", "random_seed", "output_flag")


def problem_violations(objectives: DataFrame, constraints: DataFrame, contracts: DataFrame) -> DataFrame:
    """problem_id, layer, problem: what breaks a rule. A problem without any objective is one whose constraints or contracts name it.

    All tables grow with the number of problems, so both sides of a join are shuffled and sorted; none is sent whole to a task.
    """
    o = objectives.select("problem_id", "layer", F.explode(F.array_compact(F.array(
        F.when(~F.coalesce(F.col("direction").isin("maximize", "minimize"), F.lit(False)), "unknown direction"),
        F.when(F.coalesce(F.isnan("importance") | (F.col("importance") < 0), F.lit(True)), "negative importance"),
    ))).alias("problem"))
    twice = objectives.groupBy("problem_id", "layer").agg(F.count("*").alias("n")).where("n > 1").select("problem_id", "layer", F.lit("layer twice in objectives").alias("problem"))
    c = constraints.select("problem_id", "layer", F.explode(F.array_compact(F.array(
        F.when(~F.coalesce(F.col("type").isin("aggregate", "planning_unit"), F.lit(False)), "unknown type"),
        F.when(F.col("low").isNull() & F.col("high").isNull(), "no bound"),
        F.when(F.col("low") > F.col("high"), "minimum above maximum"),
    ))).alias("problem"))
    named = objectives.select("problem_id", "layer").unionByName(constraints.select("problem_id", "layer")).distinct()
    missing = named.join(contracts.select("problem_id", "layer").hint("merge"), ["problem_id", "layer"], "left_anti").withColumn("problem", F.lit("no contract"))
    ids = constraints.select("problem_id").unionByName(contracts.select("problem_id")).distinct()
    bare = ids.join(objectives.select("problem_id").hint("merge"), "problem_id", "left_anti").select("problem_id", F.lit(None).cast("string").alias("layer"), F.lit("no objective").alias("problem"))
    return o.unionByName(twice).unionByName(c).unionByName(missing).unionByName(bare)


def evidence(contracts: DataFrame) -> DataFrame:
    """problem_id, finest, coarsest: the range of the cell sizes that a problem's layers have evidence at."""
    return contracts.groupBy("problem_id").agg(F.min("evidence").alias("finest"), F.max("evidence").alias("coarsest"))


def estimates(problems: DataFrame, contracts: DataFrame) -> DataFrame:
    """problem_id, units, source_cells, input_bytes of problems (problem_id, area in square metres, target cell size in metres):
    a layer is read at its own cell size, but once a unit at least; without an area there is no estimate."""
    rows = problems.join(contracts.select("problem_id", "native"), "problem_id", "left")
    read = F.coalesce(F.sum(F.greatest(F.lit(1.0), F.pow(F.col("target") / F.col("native"), 2))), F.lit(0.0))
    rows = rows.groupBy("problem_id").agg(F.first("area").alias("area"), F.first("target").alias("target"), read.alias("read"))
    units = F.ceil(F.col("area") / F.col("target") / F.col("target"))
    return rows.select("problem_id", units.alias("units"), F.ceil(units * F.col("read")).alias("source_cells"), F.ceil(units * F.col("read") * 4).alias("input_bytes"))


def configuration_violations(settings: DataFrame) -> DataFrame:
    """id, problem of settings (id, time_limit, relative_gap, absolute_gap, threads, options: array of names); NULL is not set."""
    taken = F.array_intersect(F.coalesce("options", F.array().cast("array<string>")), F.array(*map(F.lit, RESERVED)))
    problems = F.array_compact(F.array(
        F.when(F.col("time_limit") <= 0, "time limit not positive"),
        F.when(F.col("relative_gap") < 0, "negative relative gap"),
        F.when(F.col("absolute_gap") < 0, "negative absolute gap"),
        F.when(F.col("threads") <= 0, "no threads"),
        F.when(F.size(taken) > 0, F.concat(F.lit("reserved options: "), F.array_join(F.array_sort(taken), ", "))),
    ))
    return settings.select("id", F.explode(problems).alias("problem"))


def acceptable(status: Column, gap: Column, mode: Column, integers: Column) -> Column:
    """Whether a result may be kept: an optimum or a feasible one; in an exact audit only an optimum, of integers without a gap."""
    exact = (status == "optimal") & (~integers | F.coalesce(F.abs(gap) <= 1e-12, F.lit(False)))
    return F.coalesce(F.when(mode == "exact_audit", exact).otherwise(status.isin("optimal", "feasible")), F.lit(False))


def content_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """content_sha256 of rows in any order and any number of partitions: of their number, and of sums and exclusive ors of two
    hashes of each. Repeated rows count."""
    h, g = F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)
    sums = df.select(h.alias("h"), g.alias("g")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.bit_xor("g").alias("y"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))
    return sums.select(F.sha2(F.concat_ws(":", "n", F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0)), F.coalesce("s", F.lit(0))), 256).alias("content_sha256"))


def backfilled(tasks: DataFrame, source: DataFrame) -> DataFrame:
    """A run for every task (task_id, status, created) with the id of the one analytical source; more than one source raises."""
    one = source.agg(F.when(F.count("*") == 1, F.min("source_id")).otherwise(F.raise_error(F.lit("not one source"))).alias("source_id"))
    state = F.when(F.col("status") == "completed", "completed").when(F.col("status").isin("failed", "failed_to_submit"), "failed").otherwise("queued")
    return tasks.crossJoin(F.broadcast(one)).select("task_id", "source_id", state.alias("status"), "created")  # one row


def sorted_by_name(df: DataFrame, column: str) -> DataFrame:
    """df in the order of a language: a, A, b; equal names by their code points."""
    return df.orderBy(F.collate(F.col(column), "UNICODE"), F.col(column))


def without_repeats(df: DataFrame, key: str) -> DataFrame:
    """df; a key that occurs twice raises when it is read. Counted by key, so no task sees all rows."""
    n = df.groupBy(key).agg(F.count("*").alias("n__"))
    text = F.concat(F.lit("repeated key: "), F.col(key).cast("string"))
    once = n.where(F.when(F.col("n__") > 1, F.raise_error(text).cast("boolean")).otherwise(F.lit(True)))
    return df.join(once.select(key), key)


def started(rows: DataFrame, now: Column) -> DataFrame:
    """rows (status, started_at, completed_at) with the time of the first start and of the end set by their status."""
    ended = F.col("status").isin("completed", "failed", "cancelled")
    return rows.withColumns({"started_at": F.when(F.col("status") == "running", F.coalesce("started_at", now)).otherwise(F.col("started_at")), "completed_at": F.when(ended, F.coalesce("completed_at", now))})
