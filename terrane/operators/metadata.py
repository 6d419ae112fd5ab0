"""The relational side: live rows, memberships, latest rows, upserts, pages, change capture. ``record_end_date`` ends a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live(df: DataFrame) -> DataFrame:
    return df.where(F.col("record_end_date").isNull())


def latest(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("nth = 1").drop("nth")


def upsert(target: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of changes replace those of target with the same key; the others stay."""
    return target.join(changes.select(*key), list(key), "left_anti").unionByName(changes)


def insert_missing(target: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """What of new has no row in target yet (WHERE NOT EXISTS)."""
    return new.dropDuplicates(list(key)).join(target.select(*key), list(key), "left_anti")


def soft_delete(df: DataFrame, condition: Column, at: Column) -> DataFrame:
    return df.withColumn("record_end_date", F.when(condition & F.col("record_end_date").isNull(), at).otherwise(F.col("record_end_date")))


def partial_update(df: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns that changes gives (not NULL) replace those of df."""
    new = changes.select(key, *(F.col(c).alias(f"new_{c}") for c in columns))
    return df.join(new, key, "left").select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def search(df: DataFrame, term: str, columns: Sequence[str]) -> DataFrame:
    """Case-insensitive substring in any column; % and _ in the term are wildcards."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c), F.lit("")).ilike(f"%{term}%")
    return df.where(hit)


def page(df: DataFrame, number: int, limit: int, order: Sequence[Column]) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * limit).limit(limit)


def page_info(df: DataFrame, number: int, limit: int) -> DataFrame:
    last = F.greatest(F.lit(1), F.ceil(F.col("total") / limit))
    return df.agg(F.count("*").alias("total")).select("total", F.lit(number).alias("current_page"), last.cast("long").alias("last_page"), F.lit(limit).alias("per_page"))


def with_children(parents: DataFrame, children: DataFrame, key: str, columns: Sequence[str], name: str) -> DataFrame:
    """Parents with an array of their children's columns, sorted; empty if they have none."""
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def changed(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, operation (INSERT, UPDATE, DELETE) and JSON images of what differs, null-safely, in the given columns."""
    b = before.select(F.col(key), F.struct(*columns).alias("b"), F.lit(True).alias("in_b"))
    a = after.select(F.col(key), F.struct(*columns).alias("a"), F.lit(True).alias("in_a"))
    operation = F.when(F.col("in_b").isNull(), "INSERT").when(F.col("in_a").isNull(), "DELETE").when(~F.col("a").eqNullSafe(F.col("b")), "UPDATE")
    return b.join(a, key, "full_outer").withColumn("operation", operation).where("operation IS NOT NULL").select(key, "operation", F.to_json("b").alias("before"), F.to_json("a").alias("after"))


#: States of a run and the states that may follow them.
TRANSITIONS = {
    "queued": ("queued", "running", "failed", "cancelled"),
    "running": ("running", "completed", "failed", "cancelled"),
    "completed": ("completed",),
    "failed": ("failed", "running", "cancelled"),
    "cancelled": ("cancelled",),
}
#: States of an artifact.
ARTIFACT_TRANSITIONS = {"pending": ("pending", "building", "failed"), "building": ("building", "ready", "failed"), "ready": ("ready",), "failed": ("failed", "building")}


def bad_transitions(events: DataFrame, key: str, state: str, order: Sequence[str], allowed: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Rows whose state may not follow the state before it."""
    allowed = TRANSITIONS if allowed is None else allowed
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    ok = F.lit(False)
    for a, after in allowed.items():
        ok = ok | ((F.col("before") == a) & F.col(state).isin(*after)) if after else ok
    return events.withColumn("before", before).where(F.col("before").isNotNull() & ~ok)


def runs(events: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """Runs of equal values: key, value, their number from 0, start and stop (positions, stop not included)."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = events.withColumn("at", F.row_number().over(w) - 1).withColumn("new", (~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(w) - 1)
    return rows.groupBy(key, "run", value).agg(F.min("at").alias("start"), (F.max("at") + 1).alias("stop"))
