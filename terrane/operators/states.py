"""Rules of the metadata store as joins: state changes and what they need, permissions, invitations, defaults, constraints.

Ids are compared as they are, names and addresses without case. A NULL never equals anything unless said.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.metadata import ARTIFACT_TRANSITIONS, TRANSITIONS

#: Artifacts that must be ready, and task types that must have one reference solution, before a run completes.
REQUIRED = ("canonical_result", "pmtiles")
OPTIMIZATIONS = ("continuous_optimization", "discrete_optimization", "priority_ranking")


def may_follow(now: Column, then: Column, allowed: dict[str, Sequence[str]]) -> Column:
    """Whether a state may come after another; an unknown or missing state may come after none."""
    ok = F.lit(False)
    for state, after in allowed.items():
        ok = ok | ((now == state) & then.isin(*after))
    return F.coalesce(ok, F.lit(False))


def run_changes(runs: DataFrame, changes: DataFrame, artifacts: DataFrame, solutions: DataFrame) -> DataFrame:
    """run_id, was, status, problem (NULL: goes through) of changes (run_id, status; NULL status: nothing to check).

    runs: run_id, status, task_type. artifacts: run_id, type, status. solutions: run_id, role. A problem is unknown run,
    invalid transition, artifacts not ready, or no single reference solution.
    """
    ready = artifacts.where((F.col("status") == "ready") & F.col("type").isin(*REQUIRED)).groupBy("run_id").agg(F.count_distinct("type").alias("ready"))
    roles = solutions.groupBy("run_id").agg(F.count("*").alias("solutions"), F.count_if(F.col("role") == "reference").alias("references"))
    rows = changes.join(runs.select("run_id", F.col("status").alias("was"), "task_type"), "run_id", "left").join(ready, "run_id", "left").join(roles, "run_id", "left")
    completes = F.col("status") == "completed"
    single = (F.col("solutions") == 1) & (F.col("references") == 1)
    problem = (
        F.when(F.col("was").isNull(), "unknown run")
        .when(F.col("status").isNotNull() & ~may_follow(F.col("was"), F.col("status"), TRANSITIONS), "invalid transition")
        .when(completes & (F.coalesce("ready", F.lit(0)) < len(REQUIRED)), "artifacts not ready")
        .when(completes & F.col("task_type").isin(*OPTIMIZATIONS) & ~F.coalesce(single, F.lit(False)), "no single reference solution")
    )
    return rows.select("run_id", "was", "status", problem.alias("problem"))


def artifact_changes(artifacts: DataFrame, changes: DataFrame) -> DataFrame:
    """run_id, type, was, status, problem of changes (run_id, type, status, uri, checksum, manifest).

    An artifact is ready only with a uri, a checksum and a manifest.
    """
    rows = changes.join(artifacts.select("run_id", "type", F.col("status").alias("was")), ["run_id", "type"], "left")
    bare = F.col("uri").isNull() | F.col("checksum").isNull() | F.col("manifest").isNull()
    problem = F.when(F.col("was").isNull(), "unknown artifact").when(F.col("status").isNotNull() & ~may_follow(F.col("was"), F.col("status"), ARTIFACT_TRANSITIONS), "invalid transition").when((F.col("status") == "ready") & bare, "incomplete")
    return rows.select("run_id", "type", "was", "status", problem.alias("problem"))


def unpublished(artifacts: DataFrame) -> DataFrame:
    """Map archives that are not ready yet."""
    return artifacts.where((F.col("type") == "pmtiles") & ~F.col("status").eqNullSafe(F.lit("ready")))


def tile_changes(tiles: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """tiles (tile_id, status, uri, started_at, completed_at, failed_at) after changes (tile_id, status, uri): the time of the
    new state is set, and a completed tile takes its uri. A completion without a uri changes nothing."""
    new = changes.select("tile_id", F.upper("status").alias("to"), F.col("uri").alias("to_uri")).where("to <> 'COMPLETED' OR to_uri IS NOT NULL")
    stamp = lambda c, state: F.when(F.col("to") == state, at).otherwise(F.col(c)).alias(c)
    rows = tiles.join(new, "tile_id", "left")
    return rows.select("tile_id", F.coalesce("to", "status").alias("status"), F.when(F.col("to") == "COMPLETED", F.col("to_uri")).otherwise(F.col("uri")).alias("uri"), stamp("started_at", "STARTED"), stamp("completed_at", "COMPLETED"), stamp("failed_at", "FAILED"))


def reusable_tiles(tiles: DataFrame) -> DataFrame:
    """Of each task the latest tile (created_at, tile_id), if it is a draft or has started: no new one is made then."""
    last = Window.partitionBy("task_id").orderBy(F.desc("created_at"), F.desc("tile_id"))
    return tiles.withColumn("nth", F.row_number().over(last)).where((F.col("nth") == 1) & F.lower("status").isin("draft", "started")).drop("nth")


def authorized(requests: DataFrame, rules: DataFrame, granted: DataFrame, members: DataFrame) -> DataFrame:
    """request_id, allowed. requests: request_id, profile_id, mode (and, or). rules: request_id, kind (task, run, project or
    profile), object_id, roles (array; empty: any role). granted: kind, object_id, profile_id, role. members: profile_id,
    role, of the system; a profile rule without roles asks for member.

    A rule of another kind fails. With and, a request without rules is allowed; with or, or another mode, it is not.
    """
    own = requests.select("request_id", "profile_id", F.lower("mode").alias("mode"))
    asked = rules.join(own.select("request_id", "profile_id"), "request_id")
    held = granted.select("kind", "object_id", "profile_id", "role").unionByName(members.select(F.lit("profile").alias("kind"), F.lit(None).cast(granted.schema["object_id"].dataType).alias("object_id"), "profile_id", "role"))
    roles = F.coalesce("roles", F.array().cast("array<string>"))
    roles = F.when((F.col("kind") == "profile") & (F.size(roles) == 0), F.array(F.lit("member"))).otherwise(roles)
    asked = asked.withColumn("roles", roles)
    same = (F.col("asked.kind") == F.col("held.kind")) & (F.col("asked.profile_id") == F.col("held.profile_id")) & ((F.col("asked.kind") == "profile") | (F.col("asked.object_id") == F.col("held.object_id")))
    fits = F.col("held.role").isNotNull() & ((F.size("asked.roles") == 0) | F.exists("asked.roles", lambda r: F.lower(r) == F.lower(F.col("held.role"))))
    passed = asked.alias("asked").join(held.alias("held"), same, "left").groupBy("asked.request_id", "asked.kind", "asked.object_id", "asked.roles").agg(F.max(F.coalesce(fits, F.lit(False))).alias("ok"))
    of_request = passed.groupBy("request_id").agg(F.bool_and("ok").alias("every"), F.bool_or("ok").alias("some"))
    allowed = F.when(F.col("mode") == "and", F.coalesce("every", F.lit(True))).when(F.col("mode") == "or", F.coalesce("some", F.lit(False))).otherwise(False)
    return own.join(of_request, "request_id", "left").select("request_id", allowed.alias("allowed"))


def visible(dashboards: DataFrame, asked: DataFrame, permissions: DataFrame) -> DataFrame:
    """dashboard_id, profile_id, answer (shown, denied or not found) of asked (dashboard_id, profile_id or NULL)."""
    rows = asked.join(dashboards.select("dashboard_id", "access"), "dashboard_id", "left")
    rows = rows.join(permissions.select("dashboard_id", "profile_id").distinct().withColumn("member", F.lit(True)), ["dashboard_id", "profile_id"], "left")
    closed = F.when(F.col("profile_id").isNull(), "not found").otherwise("denied")
    answer = F.when(F.col("access").isNull(), "not found").when(F.col("access") == "NOBODY", closed).when((F.col("access") == "MEMBERS_ONLY") & F.col("member").isNull(), closed).otherwise("shown")
    return rows.select("dashboard_id", "profile_id", answer.alias("answer"))


def invited(invitations: DataFrame, profiles: DataFrame, existing: DataFrame) -> DataFrame:
    """object_id, email, profile_id, outcome (added, existing or skipped) of invitations (object_id, email). profiles:
    profile_id, email. existing: object_id, profile_id. An address counts once an object; of several profiles of one
    address the smallest id is taken."""
    wanted = invitations.select("object_id", F.lower(F.trim("email")).alias("email")).where("email <> ''").distinct()
    known = profiles.groupBy(F.lower(F.trim("email")).alias("email")).agg(F.min("profile_id").alias("profile_id"))
    rows = wanted.join(known, "email", "left").join(existing.select("object_id", "profile_id").distinct().withColumn("there", F.lit(True)), ["object_id", "profile_id"], "left")
    outcome = F.when(F.col("profile_id").isNull(), "skipped").when(F.col("there"), "existing").otherwise("added")
    return rows.select("object_id", "email", "profile_id", outcome.alias("outcome"))


def upserted(profiles: DataFrame, new: DataFrame, columns: Sequence[str], role: str = "member") -> DataFrame:
    """guid, columns, role, operation (insert, update, none) of new (guid, columns), matched without case; a profile is updated
    only if a column differs, NULL equal to NULL. Inserted ones get the role."""
    have = profiles.select(F.lower("guid").alias("key"), F.col("guid").alias("old_guid"), F.struct("guid", *columns).alias("old"), F.col("role").alias("old_role"))
    rows = new.withColumn("key", F.lower("guid")).join(have, "key", "left")
    operation = F.when(F.col("old").isNull(), "insert").when(F.struct("guid", *columns).eqNullSafe(F.col("old")), "none").otherwise("update")
    return rows.select("guid", *columns, F.when(F.col("old").isNull(), F.lit(role)).otherwise(F.col("old_role")).alias("role"), operation.alias("operation"))


def promoted(sources: DataFrame, key: str, chosen: Column) -> DataFrame:
    """sources with is_default set for the chosen key alone, in one rewrite, so that there is never more than one."""
    return sources.withColumn("is_default", F.coalesce(F.col(key) == chosen, F.lit(False)))


def deleted(df: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    """df without the rows whose key is in gone."""
    return df.join(gone.select(*key), list(key), "left_anti")


def touched(runs: DataFrame, children: DataFrame) -> DataFrame:
    """runs with revision raised by the number of their changed children (run_id)."""
    k = children.groupBy("run_id").agg(F.count("*").alias("k"))
    return runs.join(k, "run_id", "left").withColumn("revision", F.col("revision") + F.coalesce("k", F.lit(0))).drop("k")


def stamped(before: DataFrame, after: DataFrame, key: str, user: Column, at: Column) -> DataFrame:
    """after with created_at, created_by (kept from before where there was a row) and updated_at, updated_by (set where there was)."""
    old = before.select(key, F.col("created_at").alias("old_at"), F.col("created_by").alias("old_by"), F.lit(True).alias("was"))
    rows = after.drop("created_at", "created_by", "updated_at", "updated_by").join(old, key, "left")
    set_ = lambda then, otherwise: F.when(F.col("was"), then).otherwise(otherwise)
    return rows.withColumns({"created_at": set_(F.col("old_at"), at), "created_by": set_(F.col("old_by"), user), "updated_at": set_(at, None), "updated_by": set_(user, None)}).drop("old_at", "old_by", "was")


def mutated(before: DataFrame, after: DataFrame, key: str, fixed: Sequence[str]) -> DataFrame:
    """key of rows whose fixed columns differ between two snapshots, NULL equal to NULL."""
    b, a = before.select(key, F.struct(*fixed).alias("b")), after.select(key, F.struct(*fixed).alias("a"))
    return b.join(a, key).where(~F.col("a").eqNullSafe(F.col("b"))).select(key)


def repeated(df: DataFrame, key: Sequence[str], condition: Column | None = None) -> DataFrame:
    """Keys that occur more than once among the rows of the condition (a partial unique index), with their number n."""
    rows = df if condition is None else df.where(condition)
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def dangling(child: DataFrame, parent: DataFrame, key: str, to: str) -> DataFrame:
    """Rows of child whose key (if any) no row of parent has."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(to).alias(key)), key, "left_anti")


def unlike(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows whose value is none of an enumeration."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))


def renamed(df: DataFrame, column: str, names: dict[str, str], allowed: Sequence[str]) -> DataFrame:
    """df with the values of a column renamed; one that is not allowed afterwards raises."""
    new = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col(column)), F.col(column))
    return df.withColumn(column, F.when(new.isNull() | new.isin(*allowed), new).otherwise(F.raise_error(F.concat(F.lit("no such value: "), new))))


def created(projects: DataFrame, colour: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Projects (project_id, name, colour, creator), memberships and permissions of new projects: the creator is admin, and a
    project without a colour takes the given one."""
    own = projects.select("project_id", F.col("creator").alias("profile_id"))
    return projects.withColumn("colour", F.coalesce("colour", colour)), own, own.withColumn("role", F.lit("project_admin"))


def latest_of(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """key and the value of its last row by order, for all keys at once (join and top one)."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def equal_names(a: Column, b: Column) -> Column:
    """Equality without case."""
    return F.lower(a) == F.lower(b)


def sort_column(value: Column, sorted_by: dict[str, Column], default: str) -> Column:
    """The column to sort by for a requested field: one of a list, else the default."""
    out = sorted_by[default]
    for name, column in sorted_by.items():
        out = F.when(value == name, column).otherwise(out)
    return out
