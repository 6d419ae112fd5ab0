"""Vector code compression: product codes whose entries are searched by annular norm pruning.

Vectors become integers floor(256 * x) and are cut into equal consecutive parts, each with a codebook of its own. To
find a part's nearest entry, the entries are sorted by norm. The search starts at the entry next in norm and walks
outwards both ways; an entry can only be as near as the best so far if its norm lies within the best distance of the
part's own norm, so each walk ends at the edge of that annulus, which a binary search finds and which is evaluated
inclusively: ties still go to the lower index. Distances are exact integers.

Codebooks start as the parts of the vectors of the smallest ids. Each round is one pass over the table: every task sums
its own parts by entry, sums of tasks are added up by Spark, and the codebooks (`entries` vectors, whatever the input)
are all that reaches the driver.

Rows whose vector is null or holds null, NaN or infinite components are dropped, and so are rows whose vector has
another length than that of the smallest kept id. Lengths that don't divide evenly give the first parts one component
more. Repeated rows count each, but an id gives the codebooks one vector only (the least, if its rows differ); null ids
give none. Components whose squared distances would no longer fit a long are held at the bound (for 64 components about
741,000 either way). Other columns are ignored, whatever their names. An empty table gives an empty result, with the
digest of empty codebooks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from terrane.llm.shared import save

#: A label with more than one in HOT rows gets its sum by broadcast (of HOT rows at most), other labels by shuffle.
HOT = 1 << 14
LARGEST = (1 << 63) - 1


def bound(size: int) -> int:
    """Largest component for which the squared distance of two vectors of this length fits a long."""
    return math.isqrt(LARGEST // max(size, 1)) // 2


def edges(size: int, parts: int) -> list[int]:
    """Where the parts of a vector begin, and its end."""
    return [p * (size // parts) + min(p, size % parts) for p in range(parts + 1)]


def is_kept(vector: str) -> Column:
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: ok(x.cast("double")))


def integers(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that are kept, and their vectors as integers."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == size)
    x = column.take(pa.array(rows)).flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), size)
    ok = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        x = np.floor(256 * x[ok])
    return rows[ok], np.clip(x, -bound(size), bound(size)).astype(np.int64)


class Book:
    """The codebook of one part, its entries in order of their norms."""

    def __init__(self, entries: np.ndarray):
        squares = (entries * entries).sum(axis=1)
        self.index = np.argsort(squares, kind="stable")
        self.entries = entries[self.index]
        self.norms = np.sqrt(squares[self.index].astype(np.float64))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row."""
        norms = np.sqrt((x * x).sum(axis=1).astype(np.float64))
        start = np.minimum(np.searchsorted(self.norms, norms), len(self.norms) - 1)
        best, index = self.distance(x, start), self.index[start].copy()
        for step in (-1, 1):
            rows, at = np.arange(len(x)), start + step
            while len(rows):
                near = np.sqrt(best[rows].astype(np.float64)) * (1 + 1e-9) + 1e-6 * (1 + norms[rows] * 1e-6)  # no entry at the edge is lost to rounding
                if step < 0:
                    inside = at >= np.searchsorted(self.norms, norms[rows] - near, side="left")
                else:
                    inside = at < np.searchsorted(self.norms, norms[rows] + near, side="right")
                inside &= (at >= 0) & (at < len(self.norms))
                rows, at = rows[inside], at[inside]
                d, i = self.distance(x[rows], at), self.index[at]
                better = (d < best[rows]) | ((d == best[rows]) & (i < index[rows]))
                best[rows[better]], index[rows[better]] = d[better], i[better]
                at = at + step
        return index, best

    def distance(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        gap = x - self.entries[at]
        return (gap * gap).sum(axis=1)


def first_vectors(df: DataFrame, key: str, vector: str, size: int, entries: int) -> np.ndarray:
    """Integer vectors of the smallest ids. Every task passes on as many ids as are wanted, however often they repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict = {}
        for batch in batches:
            rows, x = integers(batch.column(1), size)
            ids = batch.column(0).take(pa.array(rows)).to_pylist()
            most = max(least) if len(least) == entries else None
            for k, i in enumerate(ids):
                if i is not None and (most is None or i <= most):
                    new = x[k].tolist()
                    least[i] = min(new, least.get(i, new))
                    if len(least) > entries:
                        del least[max(least)]
                        most = max(least)
        ids = sorted(least)
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([least[i] for i in ids], pa.list_(pa.int64()))], ["id", "x"])

    kind = to_arrow_type(df.schema[key].dataType)
    schema = f"id {df.schema[key].dataType.simpleString()}, x array<long>"
    found = df.select(key, vector).mapInArrow(run, schema).groupBy("id").agg(F.min("x").alias("x")).orderBy("id").limit(entries).collect()
    return np.array([r.x for r in found], np.int64).reshape(len(found), size)


def refined(df: DataFrame, vector: str, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every part goes to its nearest entry, and entries become the floors of the means of their parts."""
    cuts = np.cumsum([0, *(b.shape[1] for b in books)]).tolist()
    shared = df.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = [Book(b) for b in shared.value]
        counts = [np.zeros(len(b), np.int64) for b in shared.value]
        sums = [np.zeros(b.shape, np.int64) for b in shared.value]
        for batch in batches:
            x = integers(batch.column(0), cuts[-1])[1]
            for p, book in enumerate(searched):
                part = x[:, cuts[p] : cuts[p + 1]]
                index, _ = book.nearest(part)
                counts[p] += np.bincount(index, minlength=len(counts[p]))
                np.add.at(sums[p], index, part)
        out = [(p, e, k, int(s), int(counts[p][e])) for p in range(len(counts)) for e in np.flatnonzero(counts[p]).tolist() for k, s in enumerate(sums[p][e])]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["part", "entry", "place", "s", "c"])

    sums = df.select(vector).mapInArrow(run, "part int, entry int, place int, s long, c long")
    total = lambda c: F.sum(F.col(c).cast("decimal(19,0)")).alias(c)
    books = [b.copy() for b in books]
    for r in sums.groupBy("part", "entry", "place").agg(total("s"), total("c")).collect():  # a row for each component of the codebooks
        books[r.part][r.entry, r.place] = int(r.s) // int(r.c)
    return books


def fit(df: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2) -> list[np.ndarray]:
    """Codebooks (entries x components, integers) of the parts, fitted to all kept rows."""
    first = df.where(is_kept(vector) & F.col(key).isNotNull()).agg(F.min(F.struct(F.col(key).alias("k"), F.size(vector).alias("n"))).alias("x")).first().x
    size = first.n if first else 0
    start = first_vectors(df, key, vector, size, entries) if first else np.zeros((0, 0), np.int64)
    cuts = edges(size, parts)
    books = [start[:, a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    for _ in range(rounds if len(start) else 0):
        books = refined(df, vector, books)
    return books


def encode(df: DataFrame, books: list[np.ndarray], keys: list[str], vector: str = "embedding") -> DataFrame:
    """keys, code (two hex digits a part) and error (squared distance to the entries) of every kept row."""
    size = sum(b.shape[1] for b in books)
    shared = df.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Book(b) for b in shared.value if len(b)]
        for batch in batches:
            rows, x = integers(batch.column(len(keys)), size) if books else (np.zeros(0, np.int64), np.zeros((0, size), np.int64))
            codes, errors, at = np.zeros((len(rows), len(books)), np.uint8), np.zeros(len(rows), np.int64), 0
            for p, (book, entries) in enumerate(zip(books, shared.value, strict=False)):
                codes[:, p], error = book.nearest(x[:, at : at + entries.shape[1]])
                errors += error
                at += entries.shape[1]
            wide = codes.shape[1] * 2
            text = codes.tobytes().hex()
            kept = [batch.column(k).take(pa.array(rows)) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([text[i : i + wide] for i in range(0, len(text), wide)], pa.string()), pa.array(errors)], [*(f"k{k}" for k in range(len(keys))), "code", "error"])

    kinds = ", ".join(f"k{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(keys))
    coded = df.select(*keys, vector).mapInArrow(run, f"{kinds}, code string, error long")
    return coded.select(*(F.col(f"k{k}").alias(c) for k, c in enumerate(keys)), "code", "error")


def decode(books: list[np.ndarray], code: str) -> np.ndarray:
    """The vector that a code stands for, as integers (256 to one)."""
    return np.concatenate([b[i] for b, i in zip(books, bytes.fromhex(code), strict=True)])


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of the components of all entries by part, entry and place, in decimals with commas between."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def with_label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """coded with label_error: the sum of error over equal labels, nulls together. Rows of frequent labels don't move."""
    coded = save(coded)
    total = F.least(F.sum(F.col("error").cast("decimal(19,0)")), F.lit(LARGEST)).cast("long")
    sums = save(coded.groupBy(F.col(label).alias("of")).agg(total.alias("label_error"), F.count("*").alias("c")))
    rows = sums.agg(F.sum("c")).first()[0] or 0
    hot, cold = sums.where(F.col("c") * HOT > rows).drop("c"), sums.where(F.col("c") * HOT <= rows).drop("c")
    same = F.col(label).eqNullSafe(F.col("of"))
    known = coded.join(F.broadcast(hot), same).drop("of")
    rare = coded.join(F.broadcast(hot.select("of")), same, "left_anti").join(cold, same).drop("of")
    return known.unionByName(rare)


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """key, code, error, label_error and codebooks_sha256 of every kept row. At most 256 entries."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    books = fit(df, key, vector, parts, entries, rounds)
    return with_label_errors(encode(df, books, [key, label], vector), label).select(key, "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
