"""Substring dedup: exact repeats of 50 words and more across documents, by fixed-block anchors.

Words are runs of other than ASCII white space, unchanged. A window is WINDOW consecutive words of a document; a word
is removed if a window that covers it has a word sequence that also starts in a document with a smaller doc_id.

Every document is cut into non-overlapping reference blocks of BLOCK words; a window always holds a whole block. Blocks
are indexed by an anchor, the least hash of their GRAM-word sequences, and every rolling window of BLOCK words of every
document probes the index with its own anchor; neighbouring windows have mostly the same one and share a row. An anchor
counts if a block of a smaller doc_id meets a probe of a larger. Around these, hits are extended: all WINDOW-word
windows that hold a hit are compared by two 64-bit hashes, the smallest doc_id of each is kept, and runs of repeated
windows are the maximal exact repeats. Whole copies of a document are found by its word sequence and only the smallest
doc_id of them takes part. Nothing pairs the members of a group with each other; common passages only add up.

A window that many documents share has more than one in HOT of all places: these few windows are broadcast, so that no
task gets all places of one.

Nulls and texts without words have no words and nothing to remove. Rows of one doc_id never remove each other's words;
with different texts each is judged by its own windows, with equal texts they get the same result. Texts are read whole. Columns other than doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.shared import among, bitmap, save
from terrane.llm.text import BASES, Powers, U, passes, utf8, windows, word_hashes, words

WINDOW, BLOCK, GRAM = 50, 25, 8
HOT = 1 << 14
EMPTY = hashlib.sha256(b"").hexdigest()


def _words(batch: pa.RecordBatch) -> Iterator[tuple]:
    data, offsets = utf8(batch.column("text"))
    for i, j in passes(offsets):
        d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        yield i, j, d, *words(d, o)


def _joined(d: np.ndarray, starts: np.ndarray, ends: np.ndarray, w: np.ndarray, keep: np.ndarray) -> list[bytes]:
    """Of each document the words to keep, with one blank between them."""
    mark = np.zeros(len(d) + 1, np.int64)
    np.add.at(mark, starts[keep], 1)
    np.add.at(mark, ends[keep], -1)
    inside = np.cumsum(mark) > 0
    kept = np.flatnonzero(keep)
    doc = np.searchsorted(w, kept, "right") - 1
    more = np.zeros(len(kept), bool)
    more[:-1] = doc[1:] == doc[:-1]
    gap = ends[kept[more]]
    out = np.append(d, np.uint8(32))
    out[gap] = 32
    inside[gap] = True
    first = np.append(starts, len(d))[w]
    at = np.concatenate([[0], np.cumsum(inside)])[np.minimum(first, len(d))]
    at[-1] = inside.sum()
    out = out[inside].tobytes()
    return [out[a:b] for a, b in zip(at, at[1:], strict=False)]


def _tags(s1: np.ndarray) -> np.ndarray:
    """What tells the texts of one doc_id apart, as the high half of a place."""
    return (s1 >> U(33)).astype(np.int64) << 32


def _base(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, two hashes of the word sequence, sha256 of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, p, q = Powers(BASES[0]), Powers(BASES[0]), Powers(BASES[1])
        for batch in batches:
            for i, j, d, starts, ends, w in _words(batch):
                h = word_hashes(d, starts, ends, one)
                sha = [hashlib.sha256(x).hexdigest() for x in _joined(d, starts, ends, w, np.ones(len(starts), bool))]
                s = [pa.array(x.slices(x.sums(h), w[:-1], w[1:]).view(np.int64)) for x in (p, q)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(w), pa.int64()), *s, pa.array(sha, pa.string())], ["doc_id", "n_words", "s1", "s2", "sha"])

    return docs.mapInArrow(run, "doc_id long, n_words long, s1 long, s2 long, sha string")


def _rolling_least(g: np.ndarray, n: int) -> np.ndarray:
    """Least of every n values that follow each other."""
    have, size = g, 1
    while size * 2 <= n:
        have, size = np.minimum(have[:-size], have[size:]), size * 2
    return np.minimum(have[: len(have) - (n - size)], have[n - size :]) if n > size else have


def _anchors(docs: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """anchor, doc_id, block (else probe), and the first and last place of the windows that have it; wanted: bitmap."""
    bits = None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, many = Powers(BASES[0]), Powers(BASES[1])
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, _, d, starts, ends, w in _words(batch):
                if len(starts) < BLOCK:
                    continue
                h = word_hashes(d, starts, ends, one)
                g = many.slices(many.sums(h), np.arange(len(h) - GRAM + 1), np.arange(GRAM, len(h) + 1))
                least = _rolling_least(g, BLOCK - GRAM + 1)
                doc = np.repeat(np.arange(len(w) - 1), np.diff(w))
                q = np.arange(len(least))
                q = q[q + BLOCK <= w[doc[: len(least)] + 1]]
                if not len(q):
                    continue
                own, a = doc[q], least[q]
                head = np.ones(len(q), bool)
                head[1:] = (a[1:] != a[:-1]) | (own[1:] != own[:-1])
                last = np.append(np.flatnonzero(head)[1:] - 1, len(q) - 1)
                block = (q - w[own]) % BLOCK == 0
                anchor = np.concatenate([a[head], a[block]])
                of = np.concatenate([own[head], own[block]])
                lo = np.concatenate([q[head], q[block]]) - w[of]
                hi = np.concatenate([q[last], q[block]]) - w[of]
                role = np.arange(len(of)) >= head.sum()
                anchor = anchor.view(np.int64)
                keep = np.ones(len(of), bool) if bits is None else among(bits.value, anchor)
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (anchor, ids[of + i].astype(np.int64), role, lo, hi)], ["anchor", "doc_id", "block", "lo", "hi"])

    return docs.mapInArrow(run, "anchor long, doc_id long, block boolean, lo long, hi long")


def _windows(rows: DataFrame) -> DataFrame:
    """w1, w2, doc_id, at (place and tag): the windows of rows (doc_id, text, spans) that hold a hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, p, q = Powers(BASES[0]), Powers(BASES[0]), Powers(BASES[1])
        for batch in batches:
            ids, spans = batch.column("doc_id"), batch.column("spans")
            o = spans.offsets.to_numpy()
            lo, hi = (spans.values.field(k).to_numpy() for k in ("lo", "hi"))
            for i, j, d, starts, ends, w in _words(batch):
                h = word_hashes(d, starts, ends, one)
                mark = np.zeros(len(h) + 2, np.int64)
                own = np.repeat(np.arange(j - i), np.diff(o[i : j + 1]))
                # spans are of all texts of a doc_id, so that some may end beyond this one
                a, b = np.minimum(lo[o[i] : o[j]] + w[own], w[own + 1]), np.minimum(hi[o[i] : o[j]] + w[own], w[own + 1])
                np.add.at(mark, np.maximum(a - (WINDOW - BLOCK), w[own]), 1)
                np.add.at(mark, b + 1, -1)
                first, w1 = windows(h, w, WINDOW, p)
                keep = np.cumsum(mark)[first] > 0
                w2 = windows(h, w, WINDOW, q)[1]
                first = first[keep]
                doc = np.searchsorted(w, first, "right") - 1
                tag = _tags(p.slices(p.sums(h), w[:-1], w[1:]))
                yield pa.RecordBatch.from_arrays([pa.array(w1[keep].view(np.int64)), pa.array(w2[keep].view(np.int64)), ids.take(pa.array(doc + i)), pa.array(first - w[doc] + tag[doc])], ["w1", "w2", "doc_id", "at"])

    return rows.select("doc_id", "text", "spans").mapInArrow(run, "w1 long, w2 long, doc_id long, at long")


def _removed(rows: DataFrame) -> DataFrame:
    """doc_id, s1 (hash of the word sequence), n_removed, sha, kept (text), spans of words removed, of rows (doc_id, text, starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, p = Powers(BASES[0]), Powers(BASES[0])
        for batch in batches:
            starts_of = batch.column("starts")
            o, at = starts_of.offsets.to_numpy(), starts_of.values.to_numpy()
            for i, j, d, starts, ends, w in _words(batch):
                own = np.repeat(np.arange(j - i), np.diff(o[i : j + 1]))
                s1 = p.slices(p.sums(word_hashes(d, starts, ends, one)), w[:-1], w[1:])
                s, tag = at[o[i] : o[j]] & 0xFFFFFFFF, at[o[i] : o[j]] >> 32 << 32
                mine = tag == _tags(s1)[own]
                s = s[mine] + w[own[mine]]
                mark = np.zeros(len(starts) + 1, np.int64)
                np.add.at(mark, s, 1)
                np.add.at(mark, s + WINDOW, -1)
                gone = np.cumsum(mark)[:-1] > 0
                kept = _joined(d, starts, ends, w, ~gone)
                total = np.concatenate([[0], np.cumsum(gone)])
                edges = [np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b], [0]]).astype(np.int8))).tolist() for a, b in zip(w, w[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        pa.array(s1.view(np.int64)),
                        pa.array(total[w[1:]] - total[w[:-1]], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                        pa.array([x.decode() for x in kept], pa.string()),
                        pa.array(edges, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "s1", "n_removed", "sha", "kept", "repeats"],
                )

    return rows.select("doc_id", "text", "starts").mapInArrow(run, "doc_id long, s1 long, n_removed long, sha string, kept string, repeats array<long>")


def _chosen(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts of the documents in rows: a bitmap keeps most others from the shuffle."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(rows, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(among(bits.value, batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64))))

    return docs.mapInArrow(run, docs.schema).join(rows, "doc_id").withColumn("text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "text_hash"]).drop("text_hash")


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The base rows of all documents with ``copy`` (a whole copy of a smaller doc_id), and doc_id, s1, n_removed, sha, kept,
    repeats (places of the first word and after the last of each maximal repeat, in turn) of the others that lose words."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    base = save(_base(docs))
    docs = docs.where("doc_id IS NOT NULL")
    first = base.where(F.col("n_words") >= WINDOW).groupBy("n_words", "s1", "s2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last").drop("last")
    base = save(base.join(first, ["n_words", "s1", "s2"], "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))).drop("least"))
    block, probe = F.when(F.col("block"), F.col("doc_id")), F.when(~F.col("block"), F.col("doc_id"))
    shared = save(_anchors(docs).groupBy("anchor").agg(F.min(block).alias("least"), F.max(probe).alias("last")).where("least < last"))
    hits = _anchors(docs, bitmap(shared, "anchor")).join(shared, "anchor").where("(block AND doc_id < last) OR (NOT block AND doc_id > least)")
    spans = hits.groupBy("doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    copies = base.groupBy("doc_id").agg(F.min("copy").alias("copy")).where("copy").select("doc_id")
    spans = save(spans.join(copies, "doc_id", "left_anti"))
    texts = save(_chosen(docs, spans))
    places = _windows(texts)  # made twice from the saved texts: cheaper than a table of them
    least = places.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), F.count("*").alias("c")).where("least < last").drop("last")
    least = save(least)
    total = int(least.agg(F.sum("c")).first()[0] or 0)
    hot = least.where(F.col("c") * HOT > total).select("w1", "w2", F.col("least").alias("hot"))  # HOT rows at most
    places = places.join(F.broadcast(hot), ["w1", "w2"], "left").withColumn("w1", F.when(F.col("hot").isNull(), F.col("w1")).otherwise(F.xxhash64("doc_id", "at")))
    cold = least.where(F.col("c") * HOT <= total).drop("c")
    starts = places.join(cold, ["w1", "w2"], "left").where(F.col("doc_id") > F.coalesce("hot", "least")).groupBy("doc_id").agg(F.collect_set("at").alias("starts"))
    return base, _removed(texts.drop("spans").join(starts, "doc_id"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    base, removed = repeats(docs)
    removed = removed.select("doc_id", "s1", "n_removed", F.col("sha").alias("left"))
    sha = F.when(F.col("copy"), F.lit(EMPTY)).otherwise(F.coalesce("left", "sha")).alias("kept_sha256")
    n = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed")
    return base.join(removed, ["doc_id", "s1"], "left").select("doc_id", "n_words", n, sha)
