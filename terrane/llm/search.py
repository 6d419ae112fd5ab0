"""Ranked lexical search: WAND over shards of the documents, whose best are merged.

Items are taken in blocks of bounded size. For each block one pass over the documents counts all terms and keeps the
places of the block's terms, a table in the shared folder; the counts over all documents give the weights. A shard is a
run of rows of that table, at most SHARD postings, held by one task as posting lists in order of doc_id. For every item
WAND walks its lists: the lists are kept in order of their current document, the pivot is the first document at which the
summed maximum impacts of this shard's lists can reach the heap's worst score; lists before it skip to it by binary
search, and only where the first list stands at the pivot already is a document scored. A shard starts from the scores
that the task's earlier shards reached. Shard heaps are merged in the task, then in two steps by Spark.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased. Null and empty
texts have no terms: such documents aren't counted and never found, such items find nothing. Repeated documents are
ranked each, equal scores by ascending doc_id. Rows of one item_id with the same text count once; with different texts
each is ranked on its own, under the same id. Extra columns are ignored, whatever their names. Texts of any length are
read whole. An empty table on either side gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.shared import save

#: Bytes of item texts in a block (their terms are broadcast), and postings of a shard (several tens of bytes each).
BLOCK, SHARD = 8 << 20, 1 << 20
#: Groups of tasks whose heaps are merged first.
GROUPS = 64
_WORD = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
#: Lower case for A-Z, a blank for what is no part of a term. In UTF-8 all characters beyond ASCII are bytes from 0x80.
TABLE = bytes(c if (c := ord(chr(b).lower()) if b < 0x80 else b) in _WORD else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_factor(n: int, documents: int, length: int) -> int:
    """m: a hundred for a document of mean length, three quarters of it by length."""
    return 25 + 75 * n * documents // length


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (number of terms), term and tf (arrays: the vocabulary's terms it holds, and how often) of all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n, ends, found, times = [], [0], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = terms(text or b"")
                n.append(len(words))
                held = Counter(filter(known.__contains__, words))
                found += map(known.__getitem__, held)
                times += held.values()
                ends.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (found, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "term", "tf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, term array<int>, tf array<int>")


def wand(lists: list[tuple[list[int], list[int], int, int]], k: int, least: int) -> list[tuple[int, int]]:
    """(score, -place) of the k best documents, equal scores by place, of those that reach least.

    lists: places in ascending order, their impacts, the greatest of them, and how often the item has the term.
    """
    heap: list[tuple[int, int]] = []
    heads = [[places[0], 0, times * most, places, impacts, times] for places, impacts, most, times in lists if places]
    heads.sort(key=lambda h: h[0])
    bar = max(least, 1)
    while True:
        reach = 0
        for pivot, head in enumerate(heads):
            reach += head[2]
            if reach >= bar:
                break
        else:
            return heap
        doc = heads[pivot][0]
        if heads[0][0] == doc:
            score, moved = 0, 0
            for head in heads:
                if head[0] != doc:
                    break
                score += head[5] * head[4][head[1]]
                head[1] += 1
                moved += 1
            if score >= bar:
                if len(heap) < k:
                    heapq.heappush(heap, (score, -doc))
                else:
                    heapq.heappushpop(heap, (score, -doc))
                if len(heap) == k:
                    bar = max(bar, heap[0][0] + 1)  # later documents of equal score rank behind
        else:
            moved = pivot
            for head in heads[:pivot]:
                if head[0] < doc:
                    head[1] = bisect_left(head[3], doc, head[1] + 1)
        ended = False
        for head in heads[:moved]:
            if head[1] < len(head[3]):
                head[0] = head[3][head[1]]
            else:
                head[0], ended = -1, True
        if ended:
            heads = [h for h in heads if h[0] >= 0]
        heads.sort(key=lambda h: h[0])


class Shard:
    """Posting lists of some documents."""

    def __init__(self, rows: list[tuple], weights: np.ndarray, documents: int, length: int):
        rows.sort(key=lambda r: (r[0] is None, r[0]))
        self.ids = [r[0] for r in rows]
        m = np.array([length_factor(r[1], documents, length) for r in rows], np.int64)
        sizes = np.array([len(r[2]) for r in rows], np.int64)
        term, tf, place = np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows]).astype(np.int64), np.repeat(np.arange(len(rows)), sizes)
        order = np.argsort(term, kind="stable")
        term, tf, place = term[order], tf[order], place[order]
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[place]))
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        self.most = dict(zip(term[starts].tolist(), np.maximum.reduceat(impact, starts).tolist() if len(starts) else [], strict=True))
        self.at = dict(zip(term[starts].tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(term)], strict=True), strict=True))
        self.place, self.impact, self.lists = place, impact, {}

    def list(self, term: int) -> tuple[list[int], list[int], int]:
        if term not in self.lists:
            a, b = self.at[term]
            self.lists[term] = self.place[a:b].tolist(), self.impact[a:b].tolist(), self.most[term]
        return self.lists[term]

    def best(self, item: dict[int, int], k: int, least: int) -> list[tuple]:
        found = wand([(*self.list(t), times) for t, times in item.items() if t in self.at and self.most[t]], k, least)
        return [(-score, self.ids[-place]) for score, place in found]


def searched(index: DataFrame, items: list[dict[int, int]], weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """item (its number), doc_id, score, task: the k best documents of every task's shards."""
    shared = index.sparkSession.sparkContext.broadcast((items, weights))
    kind = index.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        best: list[list[tuple]] = [[] for _ in items]
        rows, size, ids = [], 0, None

        def flush() -> None:
            shard = Shard(rows, weights, documents, length)
            for i, item in enumerate(items):
                least = -best[i][-1][0] if len(best[i]) == k else 1
                if found := shard.best(item, k, least):
                    best[i] = sorted(best[i] + found, key=lambda x: (x[0], x[1] is None, x[1]))[:k]

        for batch in batches:
            ids = batch.column(0).type
            term, tf = batch.column(2), batch.column(3)
            a, t, f = term.offsets.to_numpy(), term.values.to_numpy(zero_copy_only=False), tf.values.to_numpy(zero_copy_only=False)
            for j, (i, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if a[j + 1] > a[j]:
                    rows.append((i, n, t[a[j] : a[j + 1]], f[a[j] : a[j + 1]]))
                    size += int(a[j + 1] - a[j])
                    if size >= SHARD:
                        flush()
                        rows, size = [], 0
        if rows:
            flush()
        out = [(i, d, -s) for i, found in enumerate(best) for s, d in found]
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), ids, pa.int64()), strict=True)], ["item", "doc_id", "score"])

    found = index.select("doc_id", "n", "term", "tf").mapInArrow(run, f"item int, doc_id {kind}, score long")
    return found.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))


def blocks(items: DataFrame) -> Iterator[list]:
    """Distinct items in blocks of BLOCK bytes (one longer item makes a block of its own)."""
    block, size = [], 0
    for r in items.select("item_id", F.col("text").cast("binary").alias("text")).where("text IS NOT NULL").distinct().toLocalIterator():
        if block and size + len(r.text) > BLOCK:
            yield block
            block, size = [], 0
        block.append(r)
        size += len(r.text)
    if block:
        yield block


def top(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above nought for each item."""
    spark, parts = docs.sparkSession, []
    kinds = items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    for block in blocks(items):
        counts = [Counter(terms(bytes(r.text))) for r in block]
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for c in counts for t in c))}
        index = save(postings(docs, vocabulary))
        documents, length = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not length:
            break
        weights = np.full(len(vocabulary), 0, np.int64)
        for r in index.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # a row for each term of the block
            weights[r.term] = weight(documents, r["count"])
        found = searched(index, [{vocabulary[t]: times for t, times in c.items()} for c in counts], weights, documents, length, k)
        for keys in (["item", "group"], ["item"]):
            place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
            found = found.withColumn("rank", place).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(block)], f"item int, item_id {kinds[0]}")
        parts.append(save(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")))
    if not parts:
        return spark.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
