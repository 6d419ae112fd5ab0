"""Change notification: a stream of events, cut to what a profile may see, latest state kept, sent on in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def notifications(events: DataFrame, visible: DataFrame) -> DataFrame:
    """JSON envelopes of the events of visible users; for a batch or a stream (stream-static semi join)."""
    return events.join(visible, "user_id", "left_semi").select(F.to_json(F.struct("event_id", "user_id", "event_type")).alias("envelope"))


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a folder of Parquet event files."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def deliver(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Everything available, batch by batch, at least once; the checkpoint folder remembers what was sent."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(events: DataFrame) -> DataFrame:
    """user_id and its last event type, by time and id."""
    last = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("nth", F.row_number().over(last)).where("nth = 1").select("user_id", "event_type", "event_id")


def changed_only(events: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """Of a batch the events after which a column differs from the key's event before, NULL equal to NULL; its first event counts
    as a change."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(F.struct(*columns)).over(w)
    return events.withColumn("before__", before).where(~F.struct(*columns).eqNullSafe(F.col("before__"))).drop("before__")


class _Changes(StatefulProcessor):
    """The last values of a key are its state; rows of a batch are compared with the row before by columns, not one by one."""

    def __init__(self, columns: list[str], order: str, schema: str, ttl: int | None):
        self.columns, self.order, self.schema, self.ttl = columns, order, schema, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.schema, self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (names of the interface)
        rows = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        now = rows[self.columns].astype(object).where(rows[self.columns].notna(), None).reset_index(drop=True)
        before = now.shift(1).astype(object)
        known = self.last.exists()
        if known:
            before.iloc[0] = list(self.last.get())
        before = before.where(before.notna(), None)
        differs = pd.Series(False, index=now.index)
        for c in self.columns:
            a, b = now[c], before[c]
            differs |= (a.isna() != b.isna()) | (a.notna() & b.notna() & (a != b))
        differs.iloc[0] |= not known
        self.last.update(tuple(x.item() if hasattr(x, "item") else x for x in now.iloc[-1]))
        yield rows[differs.to_numpy()]

    def close(self) -> None:
        pass


def with_state_store(spark: SparkSession) -> None:
    """Streams with several state variables need the state store on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def changed_stream(events: DataFrame, key: str, columns: list[str], order: str, ttl: int | None = None) -> DataFrame:
    """changed_only() of a stream: the last values of each key are its state, so a change is seen across batches and restarts.

    ttl: milliseconds after which a silent key is forgotten (its next event then counts as a change), else never.
    """
    with_state_store(events.sparkSession)
    schema = ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in columns)
    mode = "ProcessingTime" if ttl else "None"
    return events.groupBy(key).transformWithStateInPandas(_Changes(columns, order, schema, ttl), events.schema, "Append", mode)


class _Viewers(StatefulProcessor):
    """Of a task: who may see it, and its last status."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.viewers = handle.getMapState("viewers", "profile_id string", "since long")
        self.status = handle.getValueState("status", "seq long, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rows = pd.concat(list(rows)).sort_values("seq", kind="stable")
        tasks = rows.loc[rows.kind == "task", ["seq", "status"]]
        held = pd.DataFrame([(k[0], -1, True) for k in self.viewers.keys()], columns=["profile_id", "seq", "may"])
        scopes = rows.loc[rows.kind.isin(["grant", "revoke"]), ["profile_id", "seq", "kind"]]
        scopes = pd.concat([held, scopes.assign(may=scopes.kind == "grant")[["profile_id", "seq", "may"]]], ignore_index=True)
        scopes = scopes.astype({"seq": "int64", "may": bool}).sort_values("seq", kind="stable")
        out = []
        if len(tasks) and len(scopes):  # every change goes to those who may see the task just then
            each = tasks.astype({"seq": "int64"}).merge(scopes[["profile_id"]].drop_duplicates(), how="cross").sort_values("seq", kind="stable")
            each = pd.merge_asof(each, scopes, on="seq", by="profile_id")
            out.append(each.loc[each.may.fillna(False).astype(bool), ["seq", "profile_id", "status"]])
        past = tasks if not self.status.exists() else pd.concat([pd.DataFrame([self.status.get()], columns=["seq", "status"]), tasks], ignore_index=True)
        was = scopes.groupby("profile_id").may.shift(1).fillna(False).astype(bool)
        new = scopes[scopes.may & ~was & (scopes.seq >= 0)]
        if len(new) and len(past):  # who may see it from now on is told how it stands
            late = pd.merge_asof(new[["seq", "profile_id"]], past.astype({"seq": "int64"}).sort_values("seq", kind="stable").rename(columns={"seq": "at"}), left_on="seq", right_on="at")
            out.append(late.loc[late["at"].notna(), ["seq", "profile_id", "status"]])
        last = scopes.drop_duplicates("profile_id", keep="last")
        for p, may in zip(last.profile_id, last.may, strict=True):
            if may:
                self.viewers.updateValue((p,), (0,))
            elif self.viewers.containsKey((p,)):
                self.viewers.removeKey((p,))
        if len(past):
            end = past.iloc[-1]
            self.status.update((int(end.seq), end.status))
        if out:
            yield pd.concat(out, ignore_index=True).sort_values(["seq", "profile_id"]).assign(task_id=key[0])[["seq", "profile_id", "task_id", "status"]]

    def close(self) -> None:
        pass


def scoped_fan_out(messages: DataFrame) -> DataFrame:
    """seq, profile_id, task_id, status of a stream of messages (seq, kind, task_id, profile_id, status): each task change for
    everyone who may see the task at that number.

    kind: task (a change of status), grant or revoke (of a profile's right to see the task), in order of seq within a batch;
    numbers rise from batch to batch. Rights are state, so a change of scope holds from its own number on, and whoever is
    granted a right is sent the task's last status. Other kinds are ignored.
    """
    with_state_store(messages.sparkSession)
    rows = messages.select("seq", "kind", "task_id", "profile_id", "status").where("task_id IS NOT NULL AND seq IS NOT NULL")
    return rows.groupBy("task_id").transformWithStateInPandas(_Viewers(), "seq long, profile_id string, task_id string, status string", "Append", "None")


class _Outbox(StatefulProcessor):
    """Of a profile: bytes sent and acknowledged so far, what is still under way, and whether it was closed."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "sent long, acked long, closed boolean")
        self.pending = handle.getListState("pending", "seq long, upto long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rows = pd.concat(list(rows)).sort_values("seq", kind="stable").reset_index(drop=True)
        sent, acked, closed = self.sums.get() if self.sums.exists() else (0, 0, False)
        pending = pd.DataFrame(list(self.pending.get()), columns=["seq", "upto"]).astype("int64")
        out = []
        while len(rows):
            if closed:  # nothing is sent until the profile comes back, with nothing under way
                opens = rows.index[rows.kind == "open"]
                if not len(opens):
                    break
                rows, closed, acked, pending = rows.loc[opens[0] + 1 :], False, sent, pending.iloc[:0]
                continue
            size = rows.bytes.where(rows.kind == "send", 0).fillna(0).astype("int64")
            upto = sent + size.cumsum()
            flow = pd.concat([pending, pd.DataFrame({"seq": rows.seq, "upto": upto})[rows.kind == "send"]], ignore_index=True)
            done = pd.Series(acked, index=rows.index, dtype="int64")
            at = rows.index[(rows.kind == "ack") & rows.ack.notna()]
            if len(at) and len(flow):  # an ack covers what was sent before it, up to its number
                acks = pd.DataFrame({"seq": rows.ack.loc[at].astype("int64").clip(upper=rows.seq.loc[at]).cummax()})
                found = pd.merge_asof(acks, flow.astype("int64"), on="seq").upto
                done.loc[at] = found.fillna(acked).astype("int64").to_numpy()
                done = done.cummax()
            over = rows.index[(upto - done > self.limit) & (rows.kind == "send")]
            end = over[0] if len(over) else None
            part = rows if end is None else rows.loc[: end - 1]
            sends = part[part.kind == "send"]
            out.append(pd.DataFrame({"seq": sends.seq, "action": "deliver"}))
            if end is None:
                sent, acked = int(upto.iloc[-1]), int(done.iloc[-1])
                pending, rows = flow[flow.upto > acked], rows.iloc[:0]
            else:
                out.append(pd.DataFrame({"seq": [rows.seq.loc[end]], "action": ["close"]}))
                sent, closed, rows = int(upto.loc[end]), True, rows.loc[end + 1 :]
                pending = pending.iloc[:0]
        self.sums.update((sent, acked, closed))
        self.pending.clear()
        if len(pending):
            self.pending.put([(int(a), int(b)) for a, b in zip(pending.seq, pending.upto, strict=True)])
        if out:
            yield pd.concat(out, ignore_index=True).assign(profile_id=key[0])[["profile_id", "seq", "action"]]

    def close(self) -> None:
        pass


def outbox(messages: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """profile_id, seq, action of a stream of (seq, kind, profile_id, bytes, ack): deliver, or close once more than limit bytes
    are under way to a profile.

    kind: send (a message of so many bytes), ack (all up to the number ack have arrived), open (the profile is back after a
    close). What would go beyond the limit is not delivered but closes, and what follows is dropped until it is open again;
    so what is kept for a slow profile is bounded. In order of seq; numbers rise from batch to batch.
    """
    with_state_store(messages.sparkSession)
    rows = messages.select("seq", "kind", "profile_id", "bytes", "ack").where("profile_id IS NOT NULL AND seq IS NOT NULL")
    return rows.groupBy("profile_id").transformWithStateInPandas(_Outbox(limit), "profile_id string, seq long, action string", "Append", "None")


def dispatched(messages: DataFrame, column: str) -> DataFrame:
    """kind, task_id, status, profile_id of JSON messages: task (goes on to who may see it), scope (a profile's rights have
    changed), ignored (a run) or invalid (to be logged)."""
    m = F.from_json(column, "type string, task_id string, status string, profile_id string")
    rows = messages.select(m.alias("m")).select("m.*")
    whole = F.col("task_id").isNotNull() & F.col("status").isNotNull()
    kind = F.when((F.col("type") == "profile_scope.updated") & F.col("profile_id").isNotNull(), "scope").when(F.col("type") == "task_run.updated", "ignored").when((F.col("type") == "task.updated") & whole, "task").otherwise("invalid")
    return rows.select(kind.alias("kind"), "task_id", "status", "profile_id")


def fan_out(tasks: DataFrame, visible: DataFrame) -> DataFrame:
    """profile_id, task_id, status: each change for everyone who may see its task. visible (profile_id, task_id) is read anew with
    every batch of a stream, so that a changed scope holds from the next one on."""
    return visible.join(tasks.select("task_id", "status"), "task_id").select("profile_id", "task_id", "status")
