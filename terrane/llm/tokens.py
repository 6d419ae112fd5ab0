"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens; the distinct ones that a task has not counted yet are held as one ragged numpy array of
symbols. In each round every sequence looks up the ranks of its adjacent pairs, and all occurrences of each sequence's
own lowest-ranked pair are merged at once; sequences with no pair left are done, and their surviving symbols are the
count. Nulls and empty texts count 0. Repeated rows are counted each. Texts of any length are read whole. Columns other
than doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed values of byte-level BPE: bytes that stand for themselves; the others follow from code point 256 on.
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Fixed value: the pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pre-tokens that a task remembers before it starts afresh.
REMEMBERED = 400_000
#: Longest of those, so that what is remembered has a size; longer ones are counted again in the next batch.
LONGEST = 64
NONE = np.int64(1 << 40)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file."""
    rest = iter(range(256, 512))
    plain = set(PLAIN_BYTES)
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """A merge table as sorted arrays: pair key -> rank and merged symbol."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        letters = byte_letters()
        self.size = max(vocab.values()) + 1
        self.of_byte = np.array([vocab[c] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.into = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def rank(self, pairs: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.ranks[at], NONE)


def merge(table: Merges, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Symbols left of each sequence once no pair of it can be merged.

    Ranks of pairs stay from round to round; only those beside a merged pair are looked up again.
    """
    left = lengths.copy()
    active = np.flatnonzero(lengths > 1)
    symbols = symbols[np.repeat(lengths > 1, lengths)]
    lengths = lengths[active]
    seq = np.repeat(np.arange(len(active)), lengths)
    ranks = np.full(len(symbols), NONE)
    if len(symbols):
        ranks[:-1] = np.where(seq[1:] == seq[:-1], table.rank(symbols[:-1] * table.size + symbols[1:]), NONE)
    while len(active):
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        lowest = np.minimum.reduceat(ranks, starts)
        going = lowest < NONE
        at = np.flatnonzero((ranks == lowest[seq]) & (ranks < NONE))
        # in a run of equal symbols neighbouring hits overlap: take every other one from the left
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1] + 1) | (seq[at[1:]] != seq[at[:-1]])
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        symbols[at] = table.into[ranks[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        lengths = lengths - np.bincount(seq[at], minlength=len(active))
        left[active] = lengths
        beside = at - np.searchsorted(at, at)  # places of the merged pairs among what is kept
        symbols, ranks, seq = symbols[keep], ranks[keep], seq[keep]
        beside = np.concatenate([beside, beside[beside > 0] - 1])
        inner = beside[beside + 1 < len(symbols)]
        ranks[beside] = NONE
        inner = inner[seq[inner] == seq[inner + 1]]
        ranks[inner] = table.rank(symbols[inner] * table.size + symbols[inner + 1])
        going &= lengths > 1
        if not going.all():
            keep = going[seq]
            symbols, ranks, seq = symbols[keep], ranks[keep], (np.cumsum(going) - 1)[seq[keep]]
            active, lengths = active[going], lengths[going]
    return left


class Counter:
    """Counts tokens of texts with a vocabulary file of the byte-level BPE kind."""

    def __init__(self, content: str):
        file = json.loads(content)
        self.table = Merges(file["model"])
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in file["added_tokens"]))
        self.known: dict[str, int] = {}

    def learn(self, pieces: set[str]) -> None:
        """Counts the pieces not met before, all in one ragged array."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        pieces = [p for p in pieces if p not in self.known]
        tokens = [[t.encode() for t in self.pattern.findall(p)] for p in pieces]
        distinct = list({t for ts in tokens for t in ts})
        if distinct:
            lengths = np.array([len(t) for t in distinct], np.int64)
            symbols = self.table.of_byte[np.frombuffer(b"".join(distinct), np.uint8)]
            counted = dict(zip(distinct, merge(self.table, symbols, lengths).tolist(), strict=True))
            self.known.update((p, sum(counted[t] for t in ts)) for p, ts in zip(pieces, tokens, strict=True))
        else:
            self.known.update((p, 0) for p in pieces)

    def pieces(self, text: str) -> list[str]:
        """Parts that are cut into pre-tokens independently of each other.

        A single blank that no white space follows always starts a pre-token; runs of blanks are left whole.
        """
        head, *rest = text.split(" ")
        if "  " in text:
            return [text] if len(text) < 1000 else regex.findall(r"\s*\S+|\s+\Z", text)
        return [head, *(" " + x for x in rest)]

    def count(self, texts: list[str]) -> list[int]:
        parts, extra = [], []
        for text in texts:
            if "<|" in text and (found := self.special.findall(text)):
                parts.append([p for segment in self.special.split(text) for p in self.pieces(segment)])
                extra.append(len(found))
            else:
                parts.append(self.pieces(text))
                extra.append(0)
        out, known = [0] * len(texts), self.known
        i = 0
        while i < len(texts):  # as many texts at once as one ragged array should hold
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) < 4_000_000):
                size += len(texts[j])
                j += 1
            new = {p for ps in parts[i:j] for p in ps if p not in known}
            if new:
                self.learn({p for ps in parts[i:j] for p in ps} if len(known) + len(new) > REMEMBERED else new)
                known = self.known
            out[i:j] = [sum(map(known.__getitem__, ps)) + e for ps, e in zip(parts[i:j], extra[i:j], strict=True)]
            for p in new:
                if len(p) > LONGEST:
                    self.known.pop(p, None)
            i = j
        return out


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every document.

    vocabulary: a local path of the driver; its content travels with the task, about 1.5 MB.
    """
    with open(vocabulary, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(content.value)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            n = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
