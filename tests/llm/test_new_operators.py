import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from terrane.llm import packing, search, vectors
from tokenizers import Tokenizer

BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a\n \nb", "a  b \n c\t\td  ", "<|endoftext|> mid <|endoftext|><|end", " x  y\x1c z \x85", "'s don't I'LL 12 345", "日本語 текст\n\n\nx", "a" * 5000, " " * 3000 + "b", "😀 1️⃣ é", "\n", " x", "x "]


def codes_by_force(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * c) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: r[0])
    wide = len(kept[0][1]) // parts
    cut = lambda v: [v[p * wide : (p + 1) * wide] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, b: min((sum((a - c) ** 2 for a, c in zip(x, e, strict=True)), k) for k, e in enumerate(b))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                groups[p, near(x, books[p])[1]].append(x)
        for (p, e), xs in groups.items():
            books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = [(i, [near(x, books[p]) for p, x in enumerate(cut(v))], label) for i, v, label in kept]
    errors = Counter()
    for _, n, label in found:
        errors[label] += sum(d for d, _ in n)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((i, "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n), errors[label], sha) for i, n, label in found)


def test_codes_by_brute_force(spark):
    r = random.Random(5)
    rows = [(i, [r.choice((-0.5, -0.01, 0.0, 0.3, r.gauss(0, 0.1))) for _ in range(32)], r.choice((1, 1, 2, None))) for i in range(300)]
    rows += [(400 + i, [0.25] * 32, 7) for i in range(90)]
    rows += [(-3, None, 1), (-2, [math.nan] * 32, 1), (-1, [math.inf] + [0.0] * 31, 1), (500, [None] + [0.0] * 31, None), (501, [300.0, -4000.5] + [1e-9] * 30, None)]
    df = spark.createDataFrame([(*x, "x", 1) for x in rows], "vec_id long, embedding array<float>, label int, code string, error int").repartition(5)
    exact = [(i, v and [None if c is None else float(np.float32(c)) for c in v], label) for i, v, label in rows]
    assert sorted(map(tuple, vectors.compress(df).collect())) == codes_by_force(exact)
    books = vectors.fit(df)
    code = vectors.compress(df).where("vec_id = 400").first()
    assert ((vectors.decode(books, code.code) - 64) ** 2).sum() == code.error


def test_codes_of_few_repeated_uneven_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vectors.compress(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 2.0, 3.0], 1), (1, [1.0, 2.0, 3.0], 1), (1, [0.0, 2.0, 3.0], None), (2, [1.0, 2.0], 1), (None, [1.0, 2.0, 4.0], 1), (5, [1e30, -1e30, 0.0], 2)]
    got = vectors.compress(spark.createDataFrame(rows, schema), parts=2, rounds=0).collect()
    assert sorted((r.vec_id or 0, r.code) for r in got) == [(0, "0000"), (1, "0000"), (1, "0000"), (1, "0000"), (5, "0101")]
    assert {(r.label_error, r.error) for r in got if r.vec_id == 5} == {(0, 0)}
    assert vectors.edges(7, 3) == [0, 3, 5, 7]


def test_annulus_finds_what_all_entries_would(spark):
    r = np.random.default_rng(1)
    for _ in range(20):
        entries, x = r.integers(-9, 10, (64, 3)), r.integers(-12, 13, (500, 3))
        all_of_them = ((x[:, None] - entries[None]) ** 2).sum(2)
        index, d = vectors.Book(entries).nearest(x)
        assert (d == all_of_them.min(1)).all() and (index == all_of_them.argmin(1)).all()


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def test_packing_as_simulated(spark):
    """Deficit round-robin, a token at a time, over queues in the order of the table."""
    library, r = Tokenizer.from_file(BYTES), random.Random(3)
    texts = [*ODD, *(" ".join(r.choice(("one", "two", "Three,", "fourth\n")) for _ in range(r.randrange(700))) for _ in range(60))]
    rows = [(i % 70, t, r.choice(("a", "a", "a", "b", "c", None)), 5) for i, t in enumerate(texts)] + [(900 + k, "tiny", f"s{k}", 5) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, offset int").coalesce(1)
    got = packing.pack(docs, BYTES, length=256).collect()
    queues = defaultdict(list)
    for i, t, s, _ in rows:
        queues[s].append((i, ids_of(library, t)))
    total = sum(len(x) for q in queues.values() for _, x in q)
    size = lambda s: sum(len(x) for _, x in queues[s])
    own = sorted((s for s in queues if size(s) * 64 >= total), key=lambda s: (-size(s), s is not None, s))
    rest = [x for s in sorted((s for s in queues if s not in own), key=lambda s: (s is not None, s)) for x in queues[s]]
    streams = [[(d, k, t) for d, x in q for k, t in enumerate(x)] for q in ([*(queues[s] for s in own), rest])]
    weights = packing.Plan([len(q) for q in streams], [len(q) / total for q in streams], 256).weights
    deficit, at, stream = [0] * len(streams), [0] * len(streams), []
    while len(stream) < total:
        for q, tokens in enumerate(streams):
            deficit[q] += weights[q] * 256
            n = deficit[q] // sum(weights)
            deficit[q] -= n * sum(weights)
            stream += tokens[at[q] : at[q] + n]
            at[q] += n
    full, left = divmod(total, 256)
    cuts = [256 * k for k in range(full + 1)] + [256 * full + sum(1 << b for b in range(8, a - 1, -1) if left >> b & 1) for a in range(8, -1, -1) if left >> a & 1]
    spans = {(p.sequence_id, p.offset): p for p in got}
    place, seen = 0, 0
    while place < total:
        sequence = max(k for k, c in enumerate(cuts) if c <= place)
        p = spans[sequence, place - cuts[sequence]]
        ids = np.frombuffer(bytes(p.ids), "<u4").tolist()
        assert [(p.doc_id, p.start + k, t) for k, t in enumerate(ids)] == stream[place : place + p.length] and p.length == len(ids)
        assert place + p.length <= cuts[sequence + 1]
        place, seen = place + p.length, seen + 1
    assert seen == len(got) and all(n in (256, *(1 << b for b in range(9))) for n in np.diff(cuts))


def test_mixture_and_cover_over_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(7)
    pieces = packing.pack(docs, BYTES).toPandas()
    tokens = pieces.groupby("doc_id").agg(n=("length", "sum"), t=("doc_tokens", "first"))
    assert len(tokens) == docs.count() and (tokens.n == tokens.t).all()
    assert all((d.start.to_numpy()[1:] == (d.start + d.length).to_numpy()[:-1]).all() for _, d in pieces.sort_values("start").groupby("doc_id"))
    by = pieces.sort_values(["sequence_id", "offset"])
    assert all((s.offset.to_numpy()[1:] == (s.offset + s.length).to_numpy()[:-1]).all() and s.offset.iloc[0] == 0 for _, s in by.groupby("sequence_id"))
    sizes = by.groupby("sequence_id").length.sum()
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes) and sorted(sizes.index) == list(range(len(sizes)))
    of = dict(docs.select("doc_id", "source").collect())
    by["source"] = by.doc_id.map(of)
    mix = by.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0)
    target = by.groupby("source").length.sum() / by.length.sum() * 2048
    own = [s for s in mix.columns if target[s] >= 32]
    assert len(own) > 5 and (mix[own].iloc[: int(len(mix) * 0.95)] - target[own]).abs().max().max() <= len(mix.columns) + 1
    library = Tokenizer.from_file(BYTES)
    text = dict(docs.select("doc_id", "text").collect())
    for p in pieces.iloc[::50].itertuples():
        assert zlib.crc32(np.array(ids_of(library, text[p.doc_id])[p.start : p.start + p.length], "<u4").tobytes()) == zlib.crc32(bytes(p.ids))


def test_given_shares_and_no_rows(spark):
    docs = spark.createDataFrame([(k, "word " * 400, "ab"[k % 2]) for k in range(40)], "doc_id long, text string, source string")
    pieces = packing.pack(docs, BYTES, length=100, shares={"a": 0.75, "b": 0.25}).toPandas()
    early = pieces[pieces.sequence_id < 60]
    assert abs(early[early.doc_id % 2 == 0].length.sum() / early.length.sum() - 0.75) < 0.01 and pieces.length.sum() == pieces.drop_duplicates("doc_id").doc_tokens.sum()
    assert packing.pack(docs.limit(0), BYTES).count() == 0


def test_ids_as_the_library():
    library, coder = Tokenizer.from_file(BYTES), packing.Encoder(open(BYTES, encoding="utf-8").read())
    r = random.Random(2)
    odd = ["".join(r.choice(" \n\tab'sé1!  ") for _ in range(r.randrange(1, 14))) for _ in range(3000)]
    for text in [t or "" for t in ODD] + odd:
        assert np.frombuffer(coder.encode(text), coder.kind).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def ranked_by_force(docs, items, k=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, Counter(words(t))) for d, t in docs]
    n_docs, length = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if s > 0:
                scores.append((-s, d))
        out += [(item, rank, d, -s) for rank, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard", [40, 1 << 20])
def test_search_by_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(search, "SHARD", shard)
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "straße", "x_y", "A", "İ"]
    text = lambda n: " ".join(vocabulary[min(int(r.expovariate(0.08)), 64)] for _ in range(n))
    docs = [(k, text(r.randrange(60))) for k in range(300)] + [(900 + k, "w1 W2 w3-w50 w50") for k in range(40)] + [(1000, None), (1001, ""), (1002, " ,;"), (1003, "w59 " * 3000), (7, "w0 w1")]
    items = [(k, text(r.randrange(1, 25))) for k in range(30)] + [(40, None), (41, ""), (42, "unheard of"), (43, "w50 W50 w1"), (43, "w50 W50 w1")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(3)
    got = search.top(df, spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, rank int"))
    assert sorted(map(tuple, got.collect())) == ranked_by_force(docs, items[:-1])
    assert search.top(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert search.top(df, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_items_in_blocks_and_pivots(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 20)
    docs, items = [(k, f"a b{k} c{k % 3}") for k in range(20)], [(k, f"b{k} c1") for k in range(9)]
    got = search.top(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=3)
    assert sorted(map(tuple, got.collect())) == ranked_by_force(docs, items, 3)

    class Counted(list):
        read = 0

        def __getitem__(self, at):
            Counted.read += 1
            return super().__getitem__(at)

    rare = Counted([5, 70_000])
    common = Counted(range(100_000))
    found = search.wand([(rare, [100, 100], 100, 1), (common, [1] * 100_000, 1, 1)], 2, 1)
    assert sorted(found) == [(101, -70_000), (101, -5)] and Counted.read < 200  # all others are skipped
