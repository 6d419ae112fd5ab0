"""Toxicity scores: a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

Words are runs of letters and digits in lower case. The input of a word is the sum of the embeddings, by hash, of itself
and of its first and last characters in order (PIECES), beside the mean embedding of its bytes. The network reads windows of WINDOW words that overlap by half; every window of every text is
scored. The highest logit, the sum of what all windows show and their number become a score between 0 and 1 by a logistic
curve fitted on whole documents that the network was not trained on.

Training takes a bounded sample of labelled documents (SAMPLE, CALIBRATION; by hash of doc_id), never those held out.
Which words tell the classes apart in the sample chooses the windows of a toxic document that stand for it (one, or up to PER
where there are few such documents), and the most misleading window of a clean one beside another; both classes count alike; after each round of training the window of each clean document
that the network scores highest joins them. The weights (about 0.6 MB) are broadcast to the tasks.

Nulls and texts without words have one window that no word fills. Repeated rows score the same. Texts are read whole.
Labels, lang, source and doc_id are no inputs of a score. Other columns are kept. Without labels of both classes every
score is the share of toxic labels (0 without any). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm.decontam import alnum_words
from terrane.llm.shared import save
from terrane.llm.text import BASES, Powers, U, mix, passes, utf8, word_hashes

WINDOW, STEP = 32, 16
BUCKETS, EMBED, CHARS, HIDDEN, ATTEND = 1 << 15, 8, 8, 8, 8
#: Bytes of a word's pieces, from its start or (negative) from its end; a shorter word is a piece of its own.
PIECES = (3, 4, 5, 6, -3, -4)
#: Labelled documents of each class to train on; labelled documents to fit the curve on.
SAMPLE, CALIBRATION = 3000, 3000
ROUNDS, EPOCHS, BATCH, RATE, SEED = 3, 3, 128, 0.01, 7
#: Windows of toxic documents to train on: with fewer documents, each gives more of them, PER at most. Steps of a round at least.
SHOWN, PER, STEPS = 3000, 12, 210
#: By how much the log odds of a further window may be lower.
NEAR = 2.0
#: Windows that must hold a word for its embedding to be learnt.
COMMON = 8


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def spans(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows, and the offsets of the documents among them."""
    count = np.maximum(1, -(-(np.diff(w) - (WINDOW - STEP)) // STEP))
    at = np.concatenate([[0], np.cumsum(count)])
    return np.repeat(w[:-1], count) + (np.arange(at[-1]) - np.repeat(at[:-1], count)) * STEP, at


def texts(batch: pa.RecordBatch, powers: Powers) -> Iterator[tuple]:
    data, offsets = utf8(pc.utf8_lower(pc.fill_null(batch.column("text"), "")))
    for i, j in passes(offsets):
        d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, w = alnum_words(d, o)
        yield i, d, starts, ends, w, word_hashes(d, starts, ends, powers)


def buckets(d: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, powers: Powers) -> np.ndarray:
    """Buckets of each word and of its pieces (words x pieces and one)."""
    sums, out = powers.sums(d.astype(U) + U(1)), [hashes]
    for n in PIECES:
        a, b = (starts, np.minimum(ends, starts + n)) if n > 0 else (np.maximum(starts, ends + n), ends)
        out.append(mix(powers.slices(sums, a, b) + U(n % 64)))
    return (np.stack(out, 1) % U(BUCKETS)).astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def means(d: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean embedding of the bytes of each word."""
    if not len(starts):
        return np.zeros((0, table.shape[1]), np.float32)
    order = np.argsort(starts)
    cuts = np.stack([starts[order], ends[order]], 1).reshape(-1)
    rows = np.concatenate([table[d], np.zeros((1, table.shape[1]), np.float32)])
    out = np.empty((len(starts), table.shape[1]), np.float32)
    out[order] = np.add.reduceat(rows, cuts, axis=0)[::2]
    return out / (ends - starts)[:, None].astype(np.float32)


class Network:
    """Weights: E words, C bytes, W U b recurrent (by direction), A a attention, o c output; curve: slope and offset."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.p = {
            "E": np.zeros((BUCKETS, EMBED)),  # words too rare to learn stay at nought; their pieces and bytes speak for them
            "C": r.normal(0, 0.3, (256, CHARS)),
            "W": r.normal(0, 0.3, (2, EMBED + CHARS, 3 * HIDDEN)),
            "U": r.normal(0, 0.3, (2, HIDDEN, 3 * HIDDEN)),
            "b": np.zeros((2, 3 * HIDDEN)),
            "A": r.normal(0, 0.3, (2 * HIDDEN, ATTEND)),
            "a": r.normal(0, 0.3, ATTEND),
            "o": r.normal(0, 0.3, 2 * HIDDEN),
            "c": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.curve = np.array([1.0, 0.0, 0.0, 0.0])

    def run(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: list | None = None) -> tuple:
        """x: inputs of distinct words after W and b (2, words, 3H); index, mask: (T, N). Logits, and what a training step needs."""
        steps, n = index.shape
        p, h = self.p, np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((2, steps, n, HIDDEN), np.float32)
        for t in range(steps):
            back = steps - 1 - t
            x_t = np.stack([x[0][index[t]], x[1][index[back]]])
            m = np.stack([mask[t], mask[back]])[:, :, None]
            hu = h @ p["U"]
            zr = sigmoid(x_t[:, :, : 2 * HIDDEN] + hu[:, :, : 2 * HIDDEN])
            z, r, hn = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:], hu[:, :, 2 * HIDDEN :]
            c = np.tanh(x_t[:, :, 2 * HIDDEN :] + r * hn)
            if keep is not None:
                keep.append((h, z, r, hn, c, m))
            h = h + m * (1 - z) * (c - h)
            states[0, t], states[1, back] = h[0], h[1]
        s = np.concatenate([states[0], states[1]], 2)
        g = np.tanh(s @ p["A"])
        e = np.where(mask, g @ p["a"], -30)
        e = np.exp(e - e.max(0))
        e /= e.sum(0)
        pooled = np.einsum("tn,tnh->nh", e, s)
        return pooled @ p["o"] + p["c"][0], (s, g, e, pooled)

    def inputs(self, bucket: np.ndarray, chars: np.ndarray) -> np.ndarray:
        x = np.concatenate([self.p["E"][bucket].sum(1), chars], 1)
        return x @ self.p["W"] + self.p["b"][:, None]

    def gradients(self, bucket: np.ndarray, bytes_: np.ndarray, index: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> tuple[dict, float]:
        """Gradients of the mean log loss by back-propagation through time. bucket: those of each distinct word,
        bytes_: shares of the bytes in it. weight: of each window in the loss."""
        p, steps, n, keep = self.p, *index.shape, []
        bucket = bucket.reshape(len(bucket), -1)
        raw = np.concatenate([p["E"][bucket].sum(1), bytes_ @ p["C"]], 1)
        x = raw @ p["W"] + p["b"][:, None]
        logit, (s, g, e, pooled) = self.run(x, index, mask, keep)
        q = sigmoid(logit)
        d = (weight * (q - y) / n).astype(np.float32)
        out = {"o": pooled.T @ d, "c": np.array([d.sum()])}
        d_pool = d[:, None] * p["o"]
        d_e = np.einsum("nh,tnh->tn", d_pool, s)
        d_e = e * (d_e - (e * d_e).sum(0)) * mask
        d_s = e[:, :, None] * d_pool + 0
        out["a"] = np.einsum("tnk,tn->k", g, d_e)
        d_g = d_e[:, :, None] * p["a"] * (1 - g * g)
        out["A"] = np.einsum("tnh,tnk->hk", s, d_g)
        d_s += d_g @ p["A"].T
        d_states = np.stack([d_s[:, :, :HIDDEN], d_s[::-1, :, HIDDEN:]])
        d_x, d_u, d_h = np.zeros_like(x), np.zeros_like(p["U"]), np.zeros((2, n, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, hn, c, m = keep[t]
            d_h = d_h + d_states[:, t]
            d_c = d_h * m * (1 - z) * (1 - c * c)
            d_z = d_h * m * (h - c) * z * (1 - z)
            d_r = d_c * hn * r * (1 - r)
            pre = np.concatenate([d_z, d_r, d_c], 2)
            rec = np.concatenate([d_z, d_r, d_c * r], 2)
            d_u += h.transpose(0, 2, 1) @ rec
            np.add.at(d_x[0], index[t], pre[0])
            np.add.at(d_x[1], index[steps - 1 - t], pre[1])
            d_h = d_h * (1 - m * (1 - z)) + rec @ p["U"].transpose(0, 2, 1)
        out["U"], out["W"], out["b"] = d_u, raw.T @ d_x, d_x.sum(1)
        d_raw = (d_x @ p["W"].transpose(0, 2, 1)).sum(0)
        out["C"] = bytes_.T @ d_raw[:, EMBED:]
        out["E"] = np.zeros_like(p["E"])
        np.add.at(out["E"], bucket, d_raw[:, None, :EMBED])
        return out, float(-np.mean(weight * np.log(np.where(y > 0, q, 1 - q) + 1e-9)))

    def train(self, windows: list[str], y: np.ndarray) -> None:
        words = [w.split(" ") if w else [] for w in windows]
        distinct = sorted({x for w in words for x in w})
        place = {x: k + 1 for k, x in enumerate(distinct)}
        d = np.frombuffer("".join(distinct).encode(), np.uint8)
        ends = np.cumsum([len(x.encode()) for x in distinct]).astype(np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        powers = Powers(BASES[0])
        bucket = buckets(d, starts, ends, word_hashes(d, starts, ends, powers), powers)
        bucket = np.concatenate([np.zeros((1, bucket.shape[1]), np.int64), bucket])
        shares = np.zeros((len(distinct) + 1, 256), np.float32)
        own = np.repeat(np.arange(len(distinct)) + 1, ends - starts)
        np.add.at(shares, (own, d), 1 / (ends - starts)[own - 1])
        index = np.zeros((WINDOW, len(words)), np.int64)
        for k, w in enumerate(words):
            index[: len(w), k] = [place[x] for x in w]
        known = np.bincount(bucket[np.unique(index * len(words) + np.arange(len(words))) // len(words)].reshape(-1), minlength=BUCKETS) >= COMMON
        mask, r, m, v, step = index > 0, np.random.default_rng(SEED), {}, {}, 0
        share = float(np.clip(y.mean(), 0.01, 0.99))
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)  # both classes count alike
        for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(words)))):
            order = r.permutation(len(words))
            for at in range(0, len(order), BATCH):
                k = order[at : at + BATCH]
                used, inverse = np.unique(index[:, k], return_inverse=True)
                grads, _ = self.gradients(bucket[used], shares[used], inverse.reshape(WINDOW, -1), mask[:, k], y[k], weight[k])
                step += 1
                grads["E"] *= known[:, None]
                for name, g in grads.items():
                    g = np.clip(g, -1, 1)
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                    v[name] = 0.99 * v.get(name, 0) + 0.01 * g * g
                    rate = RATE * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                    self.p[name] = (self.p[name] - rate * m[name] / (np.sqrt(v[name]) + 1e-6)).astype(np.float32)

    def logits(self, d: np.ndarray, starts: np.ndarray, ends: np.ndarray, w: np.ndarray, hashes: np.ndarray, powers: Powers) -> np.ndarray:
        """The logit of each window."""
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        chars = means(d, starts[first], ends[first], self.p["C"])
        x = self.inputs(buckets(d, starts[first], ends[first], hashes[first], powers), chars)
        x = np.concatenate([x, np.zeros((2, 1, 3 * HIDDEN), np.float32)], 1)
        inverse = np.append(inverse, len(first))
        at, docs = spans(w)
        stop = np.repeat(w[1:], np.diff(docs))
        out = np.empty(len(at), np.float32)
        for k in range(0, len(at), 8192):
            place = at[k : k + 8192] + np.arange(WINDOW)[:, None]
            mask = place < stop[k : k + 8192]
            out[k : k + 8192] = self.run(x, inverse[np.where(mask, place, len(inverse) - 1)], mask)[0]
        return out

    def signs(self, *text) -> np.ndarray:
        """Of each document what its windows show: the highest logit, the logarithm of about how many passages are toxic (windows
        overlap by half, so each counts twice), and that of its windows."""
        docs = spans(text[3])[1]
        if len(docs) < 2:
            return np.zeros((0, 3))
        logits, n = self.logits(*text), np.diff(docs)
        found = np.add.reduceat(sigmoid(logits.astype(np.float64)), docs[:-1])
        return np.stack([np.maximum.reduceat(logits, docs[:-1]), np.log(found / 2 + 0.3), np.log(n)], 1)

    def score(self, signs: np.ndarray) -> np.ndarray:
        return sigmoid(signs.astype(np.float64) @ self.curve[:-1] + self.curve[-1])


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes and offset of a logistic curve, by damped Newton steps with a small ridge."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    theta, a = np.zeros(x.shape[1] + 1), np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
    for _ in range(200):
        q = sigmoid(a @ theta)
        step = np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + 1e-2 * np.eye(len(theta)), a.T @ (q - y) + 1e-2 * theta)
        theta = theta - np.clip(step, -0.3, 0.3)
    return np.append(theta[:-1] / scale, theta[-1] - (theta[:-1] * mean / scale).sum())


def _signs(rows: DataFrame) -> np.ndarray:
    """Log odds of each bucket between toxic and clean documents of the sample; BUCKETS rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(BASES[0])
        for batch in batches:
            y = batch.column("y").to_numpy()
            for i, d, starts, ends, w, h in texts(batch, powers):
                doc = np.repeat(np.arange(len(w) - 1), np.diff(w))
                key = np.unique(doc[:, None] * BUCKETS + buckets(d, starts, ends, h, powers))
                yield pa.RecordBatch.from_arrays([pa.array(key % BUCKETS), pa.array(y[key // BUCKETS + i].astype(np.int64))], ["k", "y"])

    odds, total = np.zeros((2, BUCKETS)), rows.groupBy("y").count().collect()
    for r in rows.select("text", "y").mapInArrow(run, "k long, y long").groupBy("k", "y").count().collect():
        odds[r.y, r.k] = r["count"]
    n = {r.y: r["count"] for r in total}
    return np.log((odds[1] + 0.5) / (n[1] + 1)) - np.log((odds[0] + 0.5) / (n[0] + 1))


def _windows(rows: DataFrame, odds: np.ndarray, model: Network | None = None, per: int = 1) -> tuple[list[str], np.ndarray]:
    """Of each document of the sample the window that the odds single out, of a clean one another too, of a toxic one up to
    per windows apart from each other whose odds are near; with a model, of each clean document the window that it scores
    highest."""
    shared = rows.sparkSession.sparkContext.broadcast((odds, model and model.p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, (odds, weights), own = Powers(BASES[0]), shared.value, Network()
        own.p = weights or own.p
        for batch in batches:
            y = batch.column("y").to_numpy()
            for i, d, starts, ends, w, h in texts(batch, powers):
                if not len(h):
                    continue
                at, docs = spans(w)
                if weights:
                    best = own.logits(d, starts, ends, w, h, powers)
                else:
                    value, place = np.append(odds[buckets(d, starts, ends, h, powers)].max(1), -99), at[:, None] + np.arange(WINDOW)
                    best = np.where(place < np.repeat(w[1:], np.diff(docs))[:, None], value[np.minimum(place, len(h))], -99).max(1)
                out, kind = [], []
                for k in range(len(w) - 1):
                    if w[k] == w[k + 1] or (weights and y[i + k]):
                        continue
                    here = best[docs[k] : docs[k + 1]]
                    chosen = {docs[k] + int(np.argmax(here))}
                    if y[i + k]:
                        for c in np.argsort(-here, kind="stable")[: 4 * per]:
                            if len(chosen) < per and here[c] > here.max() - NEAR and not chosen & {docs[k] + int(c) + x for x in (-1, 0, 1)}:
                                chosen.add(docs[k] + int(c))
                    if not weights and not y[i + k]:
                        chosen.add(docs[k] + int(h[w[k]] % U(docs[k + 1] - docs[k])))
                    for c in chosen:
                        a, b = at[c], min(at[c] + WINDOW, w[k + 1])
                        out.append(" ".join(d[s:t].tobytes().decode(errors="replace") for s, t in zip(starts[a:b], ends[a:b], strict=True)))
                        kind.append(y[i + k])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(kind, pa.int64())], ["window", "y"])

    got = sorted(map(tuple, rows.select("text", "y").mapInArrow(run, "window string, y long").collect()))
    return [w for w, _ in got], np.array([y for _, y in got], np.float32)


def _with_signs(docs: DataFrame, model: Network, names: list[str], finish) -> DataFrame:
    """docs with double columns: the columns of finish(what the windows of each document show)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.p, model.curve))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, powers = Network(), Powers(BASES[0])
        own.p, own.curve = shared.value
        for batch in batches:
            got = [own.signs(d, starts, ends, w, h, powers) for _, d, starts, ends, w, h in texts(batch, powers)]
            values = finish(own, np.concatenate(got) if got else np.zeros((0, 3)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, pa.float64()) for v in values)], [*batch.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)]))


def fit(docs: DataFrame, labels: DataFrame, train_on: Column | None = None) -> Network:
    """A network learnt from docs and labels (doc_id, toxic) where train_on (a condition on doc_id; default: not held out)."""
    train_on = ~held_out(F.col("doc_id")) if train_on is None else train_on
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(train_on).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    known = known.withColumn("calibrate", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).withColumn("o", F.xxhash64(F.lit(1), "doc_id"))
    take = lambda rows, n: rows.orderBy("o", "doc_id").limit(n)
    picked = take(known.where("calibrate"), CALIBRATION)
    for y in (0, 1):
        picked = picked.unionByName(take(known.where(~F.col("calibrate") & (F.col("y") == y)), SAMPLE))
    # at most 2 * SAMPLE + CALIBRATION ids, so the broadcast is bounded
    rows = save(docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id", "y", "calibrate")), "doc_id"))
    model, n = Network(), {(r.calibrate, r.y): r["count"] for r in rows.groupBy("calibrate", "y").count().collect()}
    if not (n.get((False, 0)) and n.get((False, 1))):
        share = sum(v for (_, y), v in n.items() if y) / max(1, sum(n.values()))
        model.curve = np.array([0.0, 0.0, 0.0, np.log((share + 1e-9) / (1 - share + 1e-9))])
        return model
    sample = rows.where("NOT calibrate")
    windows, y = _windows(sample, odds := _signs(sample), per=max(1, min(PER, SHOWN // n[False, 1])))
    for k in range(ROUNDS):
        if k:
            hard, clean = _windows(sample, odds, model)
            windows, y = windows + hard, np.concatenate([y, clean])
        model.train(windows, y)
    whole = _with_signs(rows.where("calibrate").select("text", "y"), model, ["a", "b", "c"], lambda _, x: x.T).select("y", "a", "b", "c").collect()
    if {r.y for r in whole} == {0, 1}:
        model.curve = logistic(np.array([r[1:] for r in whole]), np.array([r.y for r in whole], np.float64))
    return model


def score(docs: DataFrame, model: Network, name: str = "score") -> DataFrame:
    """docs with the score of every text in a column of the given name, which takes the place of a column of that name."""
    docs = docs.select(*(c for c in docs.columns if c.lower() != name.lower()))
    return _with_signs(docs, model, [name], lambda own, x: [own.score(x)])
