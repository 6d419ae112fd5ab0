"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Words are runs of letters and digits in lower case (bytes beyond ASCII count as letters). An item's set are its
distinct 5-word shingles; an item with fewer words has its word sequence as only shingle, and documents are also cut at
that length. A document contains an item if it holds at least percent of the item's shingles.

Items are partitioned by the size of their sets. Whoever holds that share of an item's n shingles lacks
n * (100 - percent) / 100 of them at most, so of the item's sketch, one MinHash value more than that for the largest
size of the partition, one is held: a document that holds none is no candidate, whatever its length, and none is lost.
The values are the least ones of an order that puts shingles of few items first. A first pass over the documents looks
for sketches only; the second counts all shingles, but only of candidates: pairs of a document and an item.

Documents without words, nulls, and items without words match nothing. Repeated rows count once; rows of one doc_id with
different texts are searched each, and the best of them counts. Texts are
read whole. Columns other than doc_id, item_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.shared import among, bitmap, save
from terrane.llm.text import BASES, Powers, U, passes, shingle_sets, utf8, windows, word_hashes

WORDS = 5
#: Lowest set sizes of the partitions.
SIZES = (1, 8, 16, 32, 64, 128, 256, 512, 1024, 4096, 1 << 40)
LETTER = np.array([(48 <= b <= 57) or (97 <= b <= 122) or b >= 128 for b in range(256)])


def alnum_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of every word of lower-cased text, and the word offsets of the documents."""
    inside = LETTER[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts], after[cuts - 1] = False, False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


def _hashes(batch: pa.RecordBatch, powers: Powers):
    data, offsets = utf8(pc.utf8_lower(pc.fill_null(batch.column("text"), "")))
    for i, j in passes(offsets):
        d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, w = alnum_words(d, o)
        yield i, j, word_hashes(d, starts, ends, powers), w


def item_shingles(items: DataFrame) -> DataFrame:
    """item_id, shingle, words (words in each shingle) of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, many = Powers(BASES[0]), Powers(BASES[1])
        for batch in batches:
            for i, j, h, w in _hashes(batch, one):
                s, o = shingle_sets(h, w, WORDS, many)
                count = np.repeat(np.arange(j - i), np.diff(o))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item_id").take(pa.array(count + i)), pa.array(s.view(np.int64)), pa.array(np.minimum(np.diff(w), WORDS)[count], pa.int64())], ["item_id", "shingle", "words"]
                )

    return items.select("item_id", "text").where("item_id IS NOT NULL").mapInArrow(run, f"item_id {items.schema['item_id'].dataType.simpleString()}, shingle long, words long").distinct()


def held(docs: DataFrame, wanted: np.ndarray, lengths: list[int], among_docs: np.ndarray | None = None) -> DataFrame:
    """doc_id, shingle: the distinct shingles of a document, of the given lengths in words, that may be wanted.

    among_docs: only documents whose hash may be in this bitmap.
    """
    bits = docs.sparkSession.sparkContext.broadcast((wanted, among_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, many = Powers(BASES[0]), Powers(BASES[1])
        wanted, among_docs = bits.value
        for batch in batches:
            if among_docs is not None:
                batch = batch.filter(pa.array(among(among_docs, batch.column("at").to_numpy(zero_copy_only=False))))
            for i, _, h, w in _hashes(batch, one):
                for n in lengths:
                    first, g = windows(h, w, n, many)
                    keep = among(wanted, g.view(np.int64))
                    doc = np.searchsorted(w, first[keep], "right") - 1 + i
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(g[keep].view(np.int64))], ["doc_id", "shingle"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("at")).where("doc_id IS NOT NULL")
    return docs.mapInArrow(run, f"doc_id {kind}, shingle long").distinct()


def sketches(shingles: DataFrame, percent: int) -> DataFrame:
    """item_id, n_item, shingle: the sketch of every item."""
    size = shingles.groupBy("item_id").agg(F.count("*").alias("n_item"))
    items = shingles.groupBy("shingle").agg(F.count("*").alias("items"))
    top = F.lit(None).cast("long")
    for low, high in zip(SIZES[::-1][1:], SIZES[::-1], strict=False):
        top = F.when(F.col("n_item").between(low, high - 1), F.lit(high - 1)).otherwise(top)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("items", F.xxhash64("shingle"), "shingle"))
    least = F.least(F.floor(top * (100 - percent) / 100) + 1, F.col("n_item"))
    return shingles.join(size, "item_id").join(items, "shingle").withColumn("rank", rank).where(F.col("rank") <= least).select("item_id", "n_item", "shingle")


def candidates(docs: DataFrame, sketch: DataFrame, lengths: list[int]) -> DataFrame:
    """doc_id, item_id, n_item: the pairs where the document holds a value of the item's sketch."""
    return held(docs, bitmap(sketch, "shingle"), lengths).join(sketch, "shingle").select("doc_id", "item_id", "n_item").distinct()


def contained(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, item_id, n_item (shingles of the item), n_shared: each item that a document contains."""
    docs = docs.select(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("h"))).alias("doc_id"), "text")
    shingles = save(item_shingles(items))
    lengths = sorted(r.words for r in shingles.select("words").distinct().collect())
    found = save(candidates(docs, save(sketches(shingles, percent)), lengths))
    pairs = found.join(shingles.select("item_id", "shingle"), "item_id")
    rows = held(docs, bitmap(shingles, "shingle"), lengths, bitmap(found.select(F.xxhash64("doc_id").alias("at")), "at"))
    both = pairs.join(rows, ["doc_id", "shingle"]).groupBy("doc_id", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    both = both.where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    return both.groupBy(F.col("doc_id.doc_id").alias("doc_id"), "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))
