"""Self join of documents on the Jaccard similarity of word n-grams, through signature trees.

Only token sets that can have a link are built whole. Tokens of one set alone can't be shared, so a set with more of them
than linked sets can differ by has no link; a part of the token space, counted over all documents, shows that of most
sets. For the sets left, all tokens are counted and put in one order, rare ones first.

The upper levels of the tree are spread over the cluster: a node is one of the rarest tokens of its sets, so many of each
set that two linked sets have one of them in common (all tokens but so many that those left are too few for a link). A
passage that many unlike documents share has frequent tokens and makes no node. Nodes with the same sets are one.

Sets are tied to one set of a node each, tied pairs are verified on whole token sets, and only verified links are
closed to components. Nodes whose sets are all of one component are done. The others become signature trees, cut into
size ranges: leaves hold a bitmap of their tokens, inner nodes the OR of their children with the ranges of size and of
surplus (tokens less bits). A dual traversal leaves node pairs whose largest possible overlap is too small, or whose
documents are all linked already. Of the nodes that two sets share only the one with the least token keeps their pair.
Pairs that come through are verified exactly, each once. So no link is lost.

Nodes of more than BLOCK sets are compared in blocks: the sets outside the largest component against all sets.

Nulls and texts without words have an empty set and are linked with nothing. Texts with fewer words than n have their
word sequence as only token. Repeated rows have equal sets and are linked. Texts are read whole, of any length. Columns
besides doc_id and text are ignored. An empty table gives an empty result. A set is known by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.shared import among, bitmap, components, save
from terrane.llm.text import BASES, Powers, U, lower_ascii, mix, passes, shingle_sets, utf8, word_hashes, words

#: Sets in a block of a large node; bytes of signatures in a task over small nodes.
BLOCK, BLOCK_SIGNED = 4096, 1 << 18
#: Children of a node of the tree; words (64 bits) of a signature unless said; bits per token.
FAN, WIDTH, BITS_PER_TOKEN = 8, 64, 4
#: A key with more than one in HOT rows is joined by broadcast (of HOT rows at most), other keys by shuffle.
HOT = 1 << 14
#: Sets of a node in one task when they are joined with what is known of the node.
SLICE = 100_000
#: Part of the token space counted first, in allowed differences.
FIRST = 1.7
#: Tokens verified in one numpy pass.
PASS_TOKENS = 1 << 20


def sets(batch: pa.RecordBatch, n: int, powers: tuple[Powers, Powers]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For passes over the batch: first and last document, the sorted tokens, and their offsets."""
    data, offsets = utf8(batch.column("text"))
    for i, j in passes(offsets):
        d, o = lower_ascii(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
        starts, ends, w = words(d, o)
        yield i, j, *shingle_sets(word_hashes(d, starts, ends, powers[0]), w, n, powers[1])


def sums(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sums modulo 2**64 of values by group, each of fewer than 2**21 values."""
    low = np.bincount(group, (values & U(0xFFFFFFFF)).astype(np.float64), groups).astype(np.uint64)
    return low + (np.bincount(group, (values >> U(32)).astype(np.float64), groups).astype(np.uint64) << U(32))


def digests(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    size = np.diff(offsets).astype(U)
    return tuple(mix(sums(mix(tokens ^ U(BASES[k])), doc, len(size)) + size * U(BASES[1 - k])) for k in range(2))


def base(docs: DataFrame, n: int, mark: list[str] = ()) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (hashes of the set) of every document; mark: columns (of long) that stay with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(BASES[0]), Powers(BASES[1])
        for batch in batches:
            got = [(np.diff(o), *digests(t, o)) for _, _, t, o in sets(batch, n, powers)]
            size, d1, d2 = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, U),) * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x.astype(U).view(np.int64)) for x in (size, d1, d2)), *(batch.column(c) for c in mark)], ["doc_id", "n_shingles", "d1", "d2", *mark])

    return docs.select(F.col("doc_id").cast("long"), "text", *mark).mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long" + "".join(f", `{c}` long" for c in mark))


def first_tokens(docs: DataFrame, n: int, percent: int, wanted: np.ndarray) -> DataFrame:
    """token, d1: the tokens of one part of the token space, of the documents that may be wanted, by the bitmap."""
    below = U(min(int(FIRST * (100 - percent) / 100 * 2**64), 2**64 - 1))
    bits = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(BASES[0]), Powers(BASES[1])
        for batch in batches:
            batch = batch.filter(pa.array(among(bits.value, batch.column("doc_id").to_numpy(zero_copy_only=False))))
            for _, _, t, o in sets(batch, n, powers):
                use = mix(t) <= below
                d1 = np.repeat(digests(t, o)[0], np.diff(o))[use]
                yield pa.RecordBatch.from_arrays([pa.array(t[use].view(np.int64)), pa.array(d1.view(np.int64))], ["token", "d1"])

    return docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL").mapInArrow(run, "token long, d1 long")


def signature(tokens: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """width words (a power of two) of bits for each set. The OR of the halves is the signature of half the width."""
    out = np.zeros((len(offsets) - 1, width), U)
    row = np.repeat(np.arange(len(out)), np.diff(offsets))
    bit = (mix(tokens) & U(width * 64 - 1)).astype(np.int64)
    np.bitwise_or.at(out.reshape(-1), row * width + (bit >> 6), U(1) << (bit & 63).astype(U))
    return out


def widths(size: np.ndarray, percent: int) -> np.ndarray:
    """Words of the signature of sets by their sizes: enough for the largest size of their range."""
    ratio = 101 / percent
    top = ratio ** (np.floor(np.log(np.maximum(size, 1)) / np.log(ratio)) + 1)
    return np.left_shift(1, np.ceil(np.log2(np.maximum(BITS_PER_TOKEN * top / 64, 1))).astype(np.int64))


def shingles(docs: DataFrame, n: int, percent: int, wanted: np.ndarray) -> DataFrame:
    """doc_id, d1, tokens (sorted), signature of the documents that may be wanted, by the bitmap."""
    bits = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(BASES[0]), Powers(BASES[1])
        for batch in batches:
            batch = batch.filter(pa.array(among(bits.value, batch.column("doc_id").to_numpy(zero_copy_only=False))))
            ids = batch.column("doc_id")
            for i, j, t, o in sets(batch, n, powers):
                d1 = pa.array(digests(t, o)[0].view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(t.view(np.int64)))
                w = widths(np.diff(o), percent).tolist()
                signs = pa.array([signature(t[o[k] : o[k + 1]], o[k : k + 2] - o[k], w[k]).tobytes() for k in range(j - i)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), d1, lists, signs], ["doc_id", "d1", "tokens", "signature"])

    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL")
    return docs.mapInArrow(run, "doc_id long, d1 long, tokens array<long>, signature binary")


class Tree:
    """Signature tree over sets in the order given: level 0 are the leaves. Nodes of disjoint cluster ranges have no link."""

    def __init__(self, sig: np.ndarray, size: np.ndarray, cluster: np.ndarray):
        surplus = size - np.bitwise_count(sig).sum(1).astype(np.int64)
        self.levels = [(sig, size, size, surplus, cluster, cluster)]
        while len(self.levels[-1][0]) > 1:
            at = np.arange(0, len(self.levels[-1][0]), FAN)
            joins = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum)
            self.levels.append(tuple(f.reduceat(x, at) for f, x in zip(joins, self.levels[-1], strict=True)))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Node pairs below which the largest possible overlap of two sets is enough for a link."""
        sig, lo, hi, surplus, first, last = self.levels[level]
        ok = (lo[i] * percent <= hi[j] * 100) & (lo[j] * percent <= hi[i] * 100) & (first[i] <= last[j]) & (first[j] <= last[i])
        i, j = i[ok], j[ok]
        if level:
            overlap = np.bitwise_count(sig[i] & sig[j]).sum(1).astype(np.int64) + np.minimum(surplus[i], surplus[j])
        else:
            overlap = np.minimum(hi[i] - np.bitwise_count(sig[i] & ~sig[j]).sum(1), hi[j] - np.bitwise_count(sig[j] & ~sig[i]).sum(1))
        ok = np.minimum(overlap, np.minimum(hi[i], hi[j])) * (100 + percent) >= (lo[i] + lo[j]) * percent
        return i[ok], j[ok]


def links(tree: Tree, tokens: list[np.ndarray] | None, label: np.ndarray, percent: int) -> list[tuple[int, int]] | np.ndarray:
    """Pairs of sets with unequal labels that the tree leaves; with tokens, those of them that are links."""
    n, step, out = len(label), np.arange(FAN), [np.zeros((0, 2), np.int64)]
    label = np.unique(label, return_inverse=True)[1]
    ends = []
    for level in range(len(tree.levels)):
        at = np.arange(0, n, FAN**level)
        ends.append((np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)))
    stack = [(len(tree.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        lo, hi = ends[level]
        apart = (lo[i] != hi[i]) | (lo[j] != hi[j]) | (lo[i] != lo[j])
        i, j = tree.possible(level, i[apart], j[apart], percent)
        if level:
            below = len(tree.levels[level - 1][0])
            ci = np.broadcast_to((i[:, None] * FAN + step)[:, :, None], (len(i), FAN, FAN)).reshape(-1)
            cj = np.broadcast_to((j[:, None] * FAN + step)[:, None, :], (len(i), FAN, FAN)).reshape(-1)
            keep = (ci < below) & (cj < below) & (ci <= cj if level > 1 else ci < cj)
            ci, cj = ci[keep], cj[keep]
            stack += [(level - 1, ci[k : k + 8192], cj[k : k + 8192]) for k in range(0, len(ci), 8192)]
        else:
            out.append(np.stack([i, j], 1))
    pairs = np.concatenate(out)
    if tokens is None:
        return pairs
    both = [len(np.intersect1d(tokens[a], tokens[b], assume_unique=True)) for a, b in pairs.tolist()]
    return [(a, b) for (a, b), k in zip(pairs.tolist(), both, strict=True) if 100 * k >= percent * (len(tokens[a]) + len(tokens[b]) - k)]


def folded(signatures: pa.Array) -> np.ndarray:
    """Signatures of several widths as rows of the least of these widths."""
    flat = np.frombuffer(signatures.buffers()[2], np.uint8) if len(signatures) else np.zeros(0, np.uint8)
    o = np.frombuffer(signatures.buffers()[1], np.int64)[signatures.offset : signatures.offset + len(signatures) + 1]
    length = np.diff(o)
    least = int(length.min())
    out = np.zeros((len(length), least // 8), U)
    for w in np.unique(length).tolist():
        of = np.flatnonzero(length == w)
        rows = np.stack([flat[o[k] : o[k + 1]] for k in of.tolist()]).view(U)
        out[of] = np.bitwise_or.reduce(rows.reshape(len(of), w // least, least // 8), axis=1)
    return out


def least_common(lists: pa.ListArray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value that the lists a and b have in common, for pairs that have one."""
    o, values = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False)
    size = np.diff(o)
    out = np.zeros(len(a), np.int64)
    for i, j in passes(np.concatenate([[0], np.cumsum(size[a] + size[b])]), PASS_TOKENS):
        of = np.concatenate([a[i:j], b[i:j]])
        row = np.repeat(np.tile(np.arange(j - i), 2), size[of])
        at = np.arange(len(row)) - np.repeat(np.cumsum(size[of]) - size[of], size[of]) + np.repeat(o[of], size[of])
        value = values[at]
        order = np.lexsort((value, row))
        value, row = value[order], row[order]
        both = np.flatnonzero((value[1:] == value[:-1]) & (row[1:] == row[:-1]))
        rows, first = np.unique(row[both], return_index=True)
        out[i + rows] = value[both[first]]
    return out


def tree_pairs(rows: DataFrame, group: list[str], percent: int) -> DataFrame:
    """a, b (d1): pairs that the signature tree of each group of rows (node, at, upper, d1, n, label, signature, nodes) leaves.

    A pair is kept at the least of the nodes that both sets have, and in one size range: not where it is below for both.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, size, label, node, at = (table.column(c).to_numpy() for c in ("d1", "n", "label", "node", "at"))
        upper, lists = table.column("upper").to_numpy(zero_copy_only=False), table.column("nodes").combine_chunks()
        cluster = np.unique(mix(node.view(U) ^ mix(at.astype(U))), return_inverse=True)[1]
        order = np.lexsort((ids, size, label, cluster))
        sig = folded(pa.chunked_array(table.column("signature").chunks, pa.binary()).cast(pa.large_binary()).combine_chunks())
        i, j = order[links(Tree(sig[order], size[order], cluster[order]), None, label[order], percent)].T
        keep = upper[i] | upper[j]
        i, j = i[keep], j[keep]
        keep = least_common(lists, i, j) == node[i]
        i, j = i[keep], j[keep]
        return pa.table({"a": pa.array(np.minimum(ids[i], ids[j]), pa.int64()), "b": pa.array(np.maximum(ids[i], ids[j]), pa.int64())})

    return rows.groupBy(*group).applyInArrow(run, "a long, b long")


def common(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """How many tokens the two sets of each row have in common."""
    out = np.zeros(len(a), np.int64)
    oa, ob = (x.offsets.to_numpy() for x in (a, b))
    ta, tb = (x.values.to_numpy(zero_copy_only=False) for x in (a, b))
    for i, j in passes((oa - oa[0]).astype(np.int64) + ob - ob[0], PASS_TOKENS):
        row = np.concatenate([np.repeat(np.arange(j - i), np.diff(o[i : j + 1])) for o in (oa, ob)])
        t = np.concatenate([ta[oa[i] : oa[j]], tb[ob[i] : ob[j]]])
        order = np.lexsort((t, row))
        t, row = t[order], row[order]
        out[i:j] = np.bincount(row[1:][(t[1:] == t[:-1]) & (row[1:] == row[:-1])], minlength=j - i)
    return out


def verified(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs that are links, by their whole token sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            both = common(x, y)
            union = np.diff(x.offsets.to_numpy()).astype(np.int64) + np.diff(y.offsets.to_numpy()) - both
            yield batch.select(["a", "b"]).filter(pa.array(100 * both >= percent * union))

    pairs = pairs.join(found.select(F.col("d1").alias("b"), F.col("tokens").alias("y")), "b")  # a hot b meets narrow rows
    pairs = pairs.join(found.select(F.col("d1").alias("a"), F.col("tokens").alias("x")), "a")
    return save(pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def least_overlap(percent: int) -> Column:
    """Tokens that a set of n shares with a linked one at least."""
    return F.expr(f"(n * {percent} + 99) div 100")


def candidates(docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """d1, n, tokens, signature of the sets that may have a link."""
    first = first_tokens(docs, n, percent, bitmap(classes, "rep"))
    alone = first.groupBy("token").agg(F.min("d1").alias("d1"), F.max("d1").alias("other")).where("d1 = other").groupBy("d1").agg(F.count("*").alias("alone"))
    sizes = classes.select(F.col("rep").alias("doc_id"), "d1", F.col("n_shingles").alias("n")).dropDuplicates(["d1"])
    left = save(sizes.join(alone, "d1", "left").where(F.coalesce("alone", F.lit(0)) <= F.col("n") - least_overlap(percent)).drop("alone"))
    found = shingles(docs, n, percent, bitmap(left, "doc_id"))
    return save(found.join(left, ["doc_id", "d1"]).dropDuplicates(["d1"]).select("d1", "n", "tokens", "signature"))


def upper_nodes(found: DataFrame, percent: int) -> DataFrame:
    """node, slice, slices, d1, n: the sets at the nodes of two sets or more; the nodes differ in their sets."""
    tokens = found.select("d1", F.explode("tokens").alias("token"))
    count = save(tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"))
    hot = F.broadcast(count.where(F.col("c") * HOT > F.lit(int(found.agg(F.sum("n")).first()[0] or 0))))
    shared = tokens.join(hot, "token").unionByName(tokens.join(hot, "token", "left_anti").join(count, "token"))
    order = shared.groupBy("d1").agg(F.array_sort(F.collect_list(F.struct("c", "token"))).alias("order")).join(found.select("d1", "n"), "d1")
    order = order.withColumn("k", F.size("order") - least_overlap(percent) + 1).where("k > 0")
    rows = order.select("d1", "n", F.explode(F.slice("order", F.lit(1), F.col("k").cast("int"))).alias("t"))
    slices = F.ceil(F.col("t.c") / SLICE)
    rows = save(rows.select(F.col("t.token").alias("node"), F.pmod(F.xxhash64("d1"), slices).alias("slice"), slices.alias("slices"), "d1", "n"))
    same = rows.groupBy("node").agg(F.max("slices").alias("slices"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("d1", F.lit(1))).alias("h1"), F.bit_xor(F.xxhash64("d1", F.lit(2))).alias("h2"))
    kept = same.where("m > 1").groupBy("m", "h1", "h2").agg(F.min_by(F.struct("node", "slices"), "node").alias("x")).select("x.*")
    return save(rows.join(sliced(kept).drop("slices"), ["node", "slice"]))


def sliced(per_node: DataFrame) -> DataFrame:
    """A row for each slice of a node, so that the sets of a hot node are joined in many tasks."""
    return per_node.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))


def labelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows with label, the component of d1 by the links so far."""
    parts = components(edges).select(F.col("node").alias("d1"), F.col("component").alias("label"))
    return rows.join(parts, "d1", "left").withColumn("label", F.coalesce("label", "d1"))


def ranged(percent: int) -> Column:
    """Number of the size range of n; the sizes of linked sets differ by less than a range is wide."""
    return F.floor(F.log("n") / float(np.log(101 / percent)))


def tied(rows: DataFrame, percent: int, seed: int) -> DataFrame:
    """a, b (d1): each set, and the set that stands for most of its nodes and size ranges, if they are not linked yet."""
    rows = rows.withColumn("at", ranged(percent))
    one = rows.groupBy("node", "at").agg(F.max("slices").alias("slices"), F.min_by(F.struct(F.col("d1").alias("b"), F.col("label").alias("other")), F.xxhash64("d1", F.lit(seed))).alias("x"))
    pairs = rows.drop("slices").join(sliced(one.select("node", "at", "slices", "x.*")).drop("slices"), ["node", "at", "slice"]).where("label <> other")
    pairs = pairs.groupBy(F.col("d1").alias("a"), "b").agg(F.count("*").alias("k"))
    return pairs.groupBy("a").agg(F.max_by("b", F.struct("k", "b")).alias("b"))


def mixed(rows: DataFrame, percent: int) -> DataFrame:
    """rows of the nodes, cut into overlapping size ranges (at; upper: the set's own), that hold sets of several labels; m: sets of the piece.

    Each set is in two pieces, its range and the one above: linked sets are of one range or of neighbouring ones, so they meet.
    """
    at = ranged(percent)
    rows = rows.withColumn("x", F.explode(F.array(F.struct(at.alias("at"), F.lit(True).alias("upper")), F.struct((at + 1).alias("at"), F.lit(False).alias("upper"))))).select("*", "x.*").drop("x")
    piece = rows.groupBy("node", "at").agg(F.max("slices").alias("slices"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m")).where("lo <> hi")
    return rows.drop("slices").join(sliced(piece).select("node", "at", "slice", "m"), ["node", "at", "slice"])


def across(large: DataFrame) -> DataFrame:
    """large in pairs of blocks g, h: all sets of a piece against those outside its largest label."""
    count = large.groupBy("node", "at", "label").agg(F.count("*").alias("k"))
    main = count.groupBy("node", "at").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.ceil((F.sum("k") - F.max("k")) / BLOCK).alias("rests"))
    rows = large.join(main, ["node", "at"]).withColumn("blocks", F.ceil(F.col("m") / BLOCK)).withColumn("g", F.pmod(F.xxhash64("d1", F.lit(1)), "blocks"))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    every = rows.withColumn("h", upto("rests"))
    few = rows.where("label <> main").withColumn("h", F.pmod(F.xxhash64("d1", F.lit(3)), "rests")).withColumn("to", upto("blocks")).where("to <> g").withColumn("g", F.col("to"))
    keep = ["node", "at", "upper", "g", "h", "d1", "n", "label", "signature", "nodes"]
    return every.select(keep).unionByName(few.select(keep))


def trees(rows: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """a, b (d1): pairs with unequal labels that the signature trees of the nodes leave, each once."""
    own = rows.groupBy("d1").agg(F.collect_list("node").alias("nodes"))
    apart = save(mixed(rows, percent).join(own, "d1").join(found.select("d1", "signature"), "d1"))
    small = apart.where(F.col("m") <= BLOCK)
    bins = int(small.agg(F.sum(F.length("signature") + 8 * F.size("nodes") + 64)).first()[0] or 0) // BLOCK_SIGNED + 1
    width = F.greatest(F.lit(0), F.ceil(F.log2(F.pow(F.lit(101 / percent), "at") * BITS_PER_TOKEN / 64)))  # of the smaller signatures of a piece
    pairs = tree_pairs(small.withColumn("w", width).withColumn("g", F.pmod(F.xxhash64("node", "at"), F.lit(bins))), ["w", "g"], percent)
    large = apart.where(F.col("m") > BLOCK)
    if not large.isEmpty():
        pairs = pairs.unionByName(tree_pairs(across(large), ["node", "at", "g", "h"], percent))
    return pairs.distinct()


def similar(docs: DataFrame, n: int = 5, percent: int = 80, mark: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included) of every document.

    Two sets are linked when 100 * intersection >= percent * union. mark: a column (of long) that stays with its row, to tell
    rows of one doc_id apart.
    """
    marks = [mark] if mark else []
    rows = save(base(docs, n, marks))
    classes = save(rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    found = candidates(docs, classes, n, percent)
    nodes = upper_nodes(found, percent)
    edges = verified(tied(nodes.withColumn("label", F.col("d1")), percent, 1), found, percent)
    edges = edges.unionByName(verified(tied(labelled(nodes, edges), percent, 2), found, percent))
    edges = edges.unionByName(verified(trees(labelled(nodes, edges), found, percent), found, percent))
    linked = classes.join(components(edges).withColumnRenamed("node", "d1"), "d1")
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = linked.join(least, "component").select("d1", "d2", "n_shingles", "component_id")
    ids = classes.join(linked, ["d1", "d2", "n_shingles"], "left").select("d1", "d2", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.where("n_shingles > 0").join(ids, ["d1", "d2", "n_shingles"], "left").select("doc_id", "n_shingles", "component_id", *marks)
    return out.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *marks))
