"""Mixture-controlled packing: deficit round-robin over the queues of the sources.

The documents of a source, in order of their place in the table, are a queue of tokens. In every round each queue earns
its share of a window of `length` tokens, sends the whole tokens it has earned and carries the rest, its deficit, into the
next round; the stream of all rounds is cut into sequences. What a queue has sent after w rounds is thus
min(total, weight * length * w div sum of weights), so its deficit at any round is known from a few totals: tasks need no state
from each other, and deficits carry across windows and partitions alike. Shares are those of the queue in all tokens,
unless others are given; queues that run out leave their room to the rest. Sources of less than LEAST of all tokens stand
in one queue together, so there are few queues whatever the table, and no source is cut to shreds.

Sequences are full, but for the end: what is left there is cut by its binary digits into sequences whose lengths are
powers of two, which need no padding.

Ids are those of the byte-level BPE vocabulary file. They are kept in the shared folder between the two passes.

Null and empty texts consist of the closing id only. Repeated rows are packed each. A null source is a source of its own.
Texts of any length are read whole and cut where windows end. Columns other than doc_id, text and the source are ignored,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.shared import save
from terrane.llm.tokens import PATTERN, byte_letters
from terrane.operators.grid import running_sum

#: Share of all tokens that gives a source a queue of its own: there are at most 64, and one for all others.
LEAST = 1 / 64
#: Rows of the table of starts up to which it is sent to the tasks; a longer one is joined by shuffle.
SENT = 1 << 20
#: Pieces of a text that a worker remembers, and their longest.
REMEMBERED, LONGEST = 700_000, 64
BLANK = re.compile(r" \s")


class Encoder(dict):
    """Ids of texts by a vocabulary file of the byte-level BPE kind; remembers the ids of a blank and the piece after it."""

    def __init__(self, content: str):
        super().__init__()
        file = json.loads(content)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in self.special}
        self.pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.plain = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kind = "<u2" if max([*ranks.values(), *self.special.values()]) < 1 << 16 else "<u4"

    def ids(self, text: str) -> bytes:
        return np.array(self.plain.encode_ordinary(text), self.kind).tobytes()

    def __missing__(self, piece: str) -> bytes:
        found = self.ids(" " + piece)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as unsigned integers of self.kind. A blank that no white space follows starts a token, whatever stands before."""
        if self.pattern and self.pattern.search(text):
            return b"".join(np.array([self.special[x]], self.kind).tobytes() if x in self.special else self.encode(x) for x in self.pattern.split(text))
        if BLANK.search(text):
            return b"".join(self[x[1:]] if x[0] == " " else self.ids(x) for x in re.split(r"(?= \S)", text) if x)
        head, *rest = text.split(" ")
        return self.ids(head) + b"".join(map(self.__getitem__, rest))


_ENCODERS: dict[int, Encoder] = {}


def encoder(content: str) -> Encoder:
    """One for each Python worker, so that tasks after the first find their words."""
    key = hash(content)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(content)
    return _ENCODERS[key]


def encoded(docs: DataFrame, content: str, end: int, source: str) -> tuple[DataFrame, str]:
    """doc_id, source, part (number of the task), before (tokens of that source earlier in the task), n, ids; and the kind of ids."""
    shared = docs.sparkSession.sparkContext.broadcast(content)
    kind = Encoder(content).kind
    if end >= 1 << 8 * int(kind[-1]):
        kind = "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, sent = encoder(shared.value), TaskContext.get().partitionId(), {}
        last = np.array([end], kind).tobytes()
        for batch in batches:
            before, n, ids = [], [], []
            for text, of in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = coder.encode(text or "")
                x = (x if coder.kind == kind else np.frombuffer(x, coder.kind).astype(kind).tobytes()) + last
                size = len(x) // int(kind[-1])
                ids.append(x)
                n.append(size)
                before.append(sent.get(of, 0))
                sent[of] = before[-1] + size
            arrays = [batch.column(0), batch.column(2), pa.array([part] * len(n), pa.int32()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "source", "part", "before", "n", "ids"])

    types = docs.schema["doc_id"].dataType.simpleString(), docs.schema[source].dataType.simpleString()
    rows = docs.select("doc_id", "text", source).mapInArrow(run, f"doc_id {types[0]}, source {types[1]}, part int, before long, n long, ids binary")
    return rows, kind


class Plan:
    """Where the tokens of every queue come to stand in the stream and in sequences."""

    def __init__(self, totals: list[int], shares: list[float], length: int):
        self.totals, self.length, self.total = totals, length, sum(totals)
        whole = sum(s for s, t in zip(shares, totals, strict=True) if t) or 1
        for bits in range(16, 0, -1):  # as fine as shares can be in whole numbers of 64 bits
            self.weights = [max(1, round(s * (1 << bits) / whole)) if t else 1 for s, t in zip(shares, totals, strict=True)]
            self.sum = sum(self.weights)
            if max(self.weights) * (max(self.sum * t // w for w, t in zip(self.weights, totals, strict=True)) + 2 * length) < 1 << 62:
                break
        self.full, rest = divmod(self.total, length)
        digits = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.starts = self.full * length + np.cumsum([0, *digits])

    def sent(self, queue: int, rounds):
        """Tokens that a queue has sent after so many rounds."""
        return np.minimum(self.totals[queue], self.weights[queue] * (rounds * self.length) // self.sum)

    def round(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The round in which a queue sends its token of this number."""
        earned = np.array(self.weights)[queue]
        windows = -(-self.sum * (token + 1) // earned)  # tokens of the stream, were all queues sending
        return -(-windows // self.length) - 1

    def runs(self, queue: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, start (in the row), length and place in the stream of the runs that rows of queues are sent in."""
        a, b = self.round(queue, first), self.round(queue, first + n - 1)
        size = b - a + 1
        row = np.repeat(np.arange(len(n)), size)
        w = a[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        q, stream, start, stop = queue[row], np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for k in range(len(self.totals)):
            before, after = self.sent(k, w), self.sent(k, w + 1)
            stream += before + np.where(k < q, after - before, 0)
            start, stop = np.where(k == q, before, start), np.where(k == q, after, stop)
        lo, hi = np.maximum(start, first[row]), np.minimum(stop, (first + n)[row])
        some = hi > lo
        return row[some], (lo - first[row])[some], (hi - lo)[some], (stream + lo - start)[some]

    def sequence(self, place: np.ndarray) -> np.ndarray:
        return np.where(place < self.full * self.length, place // self.length, self.full + np.searchsorted(self.starts, place, side="right") - 1)

    def begins(self, sequence: np.ndarray) -> np.ndarray:
        return np.where(sequence < self.full, sequence * self.length, self.starts[np.clip(sequence - self.full, 0, len(self.starts) - 1)])

    def pieces(self, queue: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, start, length, sequence and offset of all pieces."""
        row, start, size, place = self.runs(queue, first, n)
        a, b = self.sequence(place), self.sequence(place + size - 1)
        count = b - a + 1
        of = np.repeat(np.arange(len(row)), count)
        s = a[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        lo, hi = np.maximum(place[of], self.begins(s)), np.minimum((place + size)[of], self.begins(s + 1))
        row, start, size, offset = row[of], start[of] + lo - place[of], hi - lo, lo - self.begins(s)
        # runs of one row that follow each other in a sequence are one piece
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (s[1:] != s[:-1]) | (offset[1:] != offset[:-1] + size[:-1])
        heads = np.flatnonzero(new)
        return row[heads], start[heads], np.add.reduceat(size, heads) if len(heads) else size, s[heads], offset[heads]


def pack(docs: DataFrame, vocabulary: str, length: int = 2048, end: int = 1, source: str = "source", shares: Mapping[str | None, float] | None = None) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset of every piece; ids are little-endian unsigned 32-bit integers.

    vocabulary: a local path of the driver. end: the id that closes every document. shares: target proportions by source
    (at most 64; what they leave of 1 goes to all other sources together); those of the table unless given.
    """
    if shares is not None and len(shares) > 64:
        raise ValueError("at most 64 sources can have shares of their own")
    with open(vocabulary, encoding="utf-8") as file:
        rows, kind = encoded(docs, file.read(), end, source)
    rows = save(rows)
    counts = save(rows.groupBy("part", "source").agg(F.sum("n").alias("tokens")))
    total = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    sums = counts.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    if shares is None:
        own = sums.where(F.col("tokens") >= F.lit(LEAST * total)).orderBy(F.desc("tokens"), "source").collect()
    else:
        own = sums.where(F.col("source").isin([s for s in shares if s is not None]) | (F.col("source").isNull() if None in shares else F.lit(False))).orderBy("source").collect()
    totals = [r.tokens for r in own]
    totals.append(total - sum(totals))
    wanted = [t / max(total, 1) for t in totals] if shares is None else [shares[r.source] for r in own] + [max(0.0, 1 - sum(shares.values()))]
    plan = Plan(totals, wanted, length)
    queue = F.lit(len(own))
    for k, r in enumerate(own):
        queue = F.when(F.col("source").eqNullSafe(F.lit(r.source)), k).otherwise(queue)
    ordered = counts.withColumn("queue", queue).withColumn("key", F.struct("queue", "part", "source"))
    ends = running_sum(ordered, "key", False, "key", "tokens", "stop")
    before = F.element_at(F.array(*(F.lit(sum(totals[:k])).cast("long") for k in range(len(totals)))), F.col("queue") + 1)
    starts = save(ends.select(F.col("part").alias("of_part"), F.col("source").alias("of_source"), "queue", (F.col("stop") - F.col("tokens") - before).alias("first")))
    if starts.count() <= SENT:
        starts = F.broadcast(starts)
    placed = rows.join(starts, (F.col("part") == F.col("of_part")) & F.col("source").eqNullSafe(F.col("of_source")))
    placed = placed.select("doc_id", "queue", (F.col("first") + F.col("before")).alias("first"), "n", "ids")
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            queue, first, n = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3))
            row, start, size, sequence, offset = plan.pieces(queue, first, n)
            ids, cut, of = batch.column(4), [], -1
            for r, a, k in zip(row.tolist(), start.tolist(), size.tolist(), strict=True):
                if r != of:
                    of, whole = r, np.frombuffer(ids[r].as_buffer(), kind).astype("<u4")
                cut.append(whole[a : a + k].tobytes())
            arrays = [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(size), pa.array(cut, pa.binary()), pa.array(n[row]), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(run, schema)
