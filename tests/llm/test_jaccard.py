import random

import numpy as np
import pytest
from terrane.llm import jaccard
from terrane.llm.shared import components


def brute(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = [x for x in "".join(c.lower() if c.isascii() else c for c in t or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {(i, len(sets[i]), find(i)) for i in ids}


def near_copies(seed, docs=60, length=60, copies=6, vocabulary=400):
    r, rows = random.Random(seed), []
    for _ in range(docs):
        w = [f"w{r.randrange(vocabulary)}" for _ in range(r.randrange(1, length))]
        for _ in range(r.randrange(1, copies)):
            v = list(w)
            for _ in range(r.randrange(0, 3)):
                v[r.randrange(len(v))] = f"x{r.randrange(vocabulary)}"
            rows.append(" ".join(v))
    return [(7 * i + 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 75)])
def test_same_as_brute_force(spark, n, percent):
    rows = [*near_copies(n), (1, None), (2, ""), (100_000, " \n\t "), (100_001, "Aa bB"), (100_002, "aA Bb"), (100_003, "É x"), (100_004, "é x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {tuple(r) for r in jaccard.similar(docs, n, percent).collect()} == brute(rows, n, percent)


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "BLOCK_SIGNED", 8)
    rows = near_copies(5, docs=3, length=90, copies=40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in jaccard.similar(docs, 3, 90).collect()} == brute(rows, 3, 90)


def test_tree_finds_what_all_pairs_find():
    r = np.random.default_rng(1)
    base = [np.unique(r.integers(0, 1 << 63, r.integers(1, 80)).astype(np.uint64)) for _ in range(20)]
    sets = [np.unique(np.where(r.random(len(b)) < 0.06, r.integers(0, 1 << 63, len(b)).astype(np.uint64), b)) for b in base for _ in range(8)]
    size = np.array([len(x) for x in sets])
    sig = jaccard.signature(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]))
    got = jaccard.links(jaccard.Tree(sig, size, np.zeros(len(sets), np.int64)), sets, np.arange(len(sets)), 80)
    part = np.arange(len(sets))
    want = np.arange(len(sets))
    for a, b in got:
        part = np.where(part == part[b], part[a], part)
    for a in range(len(sets)):
        for b in range(a):
            i = len(np.intersect1d(sets[a], sets[b]))
            if 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                want = np.where(want == want[b], want[a], want)
    assert len(np.unique(np.stack([part, want]), axis=1)[0]) == len(np.unique(part)) == len(np.unique(want))


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, d1 string, key int, cluster int")
    assert jaccard.similar(empty).columns == ["doc_id", "n_shingles", "component_id"]
    assert jaccard.similar(empty).count() == 0
    clash = spark.createDataFrame([(4, "a b c d e f", "x", 1), (2, "a b c d e f", "y", 2), (2, "a b c d e f", "y", 2)], "doc_id long, text string, d1 string, component_id int")
    assert sorted(map(tuple, jaccard.similar(clash).collect())) == [(2, 2, 2), (2, 2, 2), (4, 2, 2)]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 90), (95, 100), (7, 7), (200, 200)], "a long, b long")
    got = dict(map(tuple, components(edges).collect()))
    assert got == {**dict.fromkeys(range(51), 0), 90: 90, 95: 90, 100: 90, 200: 200}
