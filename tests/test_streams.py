import random

from terrane.streaming import changes


class Stream:
    """Files put one after another, each followed by a run of the stream that a restart goes on with."""

    def __init__(self, spark, folder, schema, make):
        self.spark, self.folder, self.schema, self.make, self.seen = spark, folder, schema, make, []

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.make(self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in"))
        changes.deliver(stream, lambda batch, _: self.seen.extend(map(tuple, batch.collect())), f"{self.folder}/checkpoint").awaitTermination()
        out, self.seen = sorted(self.seen), []
        return out


def test_changes_with_nulls_and_numbers(spark, tmp_path):
    schema = "id long, key string, a string, n double"
    s = Stream(spark, tmp_path, schema, lambda x: changes.changed_stream(x, "key", ["a", "n"], "id").select("id"))
    assert s.put([(1, "k", "x", None), (2, "k", "x", None), (3, "k", None, None), (4, "k", None, 1.0), (5, "m", None, None), (6, "k", None, 1.0)]) == [(1,), (3,), (4,), (5,)]
    assert s.put([(7, "k", None, 1.0), (8, "k", None, 2.0), (9, "m", None, None), (10, "m", "", None)]) == [(8,), (10,)]


def test_scopes_hold_from_their_own_number_on(spark, tmp_path):
    schema = "seq long, kind string, task_id string, profile_id string, status string"
    s = Stream(spark, tmp_path, schema, changes.scoped_fan_out)
    got = s.put([(1, "task", "t", None, "queued"), (2, "grant", "t", "p", None), (3, "task", "t", None, "running"), (4, "grant", "u", "q", None), (5, "odd", "t", "p", None), (6, "grant", "t", "p", None)])
    assert got == [(2, "p", "t", "queued"), (3, "p", "t", "running")]
    got = s.put([(7, "task", "t", None, "done"), (8, "revoke", "t", "p", None), (9, "task", "t", None, "late"), (10, "grant", "t", "q", None), (11, "task", "u", None, None)])
    assert got == [(7, "p", "t", "done"), (10, "q", "t", "late"), (11, "q", "u", None)]
    assert s.put([(12, "task", "t", None, "end"), (13, None, "t", None, None), (14, "task", None, None, "x")]) == [(12, "q", "t", "end")]


def outbox_by_hand(messages, limit):
    out, under_way, closed = [], {}, {}
    for seq, kind, p, size, ack in messages:
        way = under_way.setdefault(p, [])
        if kind == "open":
            if closed.get(p):
                closed[p], way[:] = False, []
        elif closed.get(p):
            continue
        elif kind == "ack":
            way[:] = [(s, b) for s, b in way if s > ack]
        elif kind == "send":
            if sum(b for _, b in way) + size > limit:
                closed[p] = True
                out.append((p, seq, "close"))
            else:
                way.append((seq, size))
                out.append((p, seq, "deliver"))
    return sorted(out)


def test_slow_profiles_are_closed(spark, tmp_path):
    r, messages = random.Random(5), []
    for seq in range(1, 240):
        kind = r.choices(("send", "ack", "open"), (8, 3, 1))[0]
        messages.append((seq, kind, r.choice("pq"), r.randrange(1, 40) if kind == "send" else None, max(0, seq - r.randrange(1, 12)) if kind == "ack" else None))
    s = Stream(spark, tmp_path, "seq long, kind string, profile_id string, bytes long, ack long", lambda x: changes.outbox(x, 100))
    got = sum((s.put(messages[a:b]) for a, b in ((0, 90), (90, 91), (91, 240))), [])
    assert sorted(got) == outbox_by_hand(messages, 100) and {x[2] for x in got} == {"deliver", "close"}
