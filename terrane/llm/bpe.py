"""BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that are never neighbours inside any token of the vocabulary can never end up in one token, so
every such place in a word is a certain cut. Words fall into short fragments there; each distinct fragment is encoded
once on its own and the ids are concatenated. The last fragment of a word carries the word end.

Nulls and empty texts have no ids and decode to the empty text. Repeated rows are encoded each. Texts of any length
are read whole. Columns other than doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed values of byte-level BPE: bytes that stand for themselves; the others follow from code point 256 on.
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Fixed values of this vocabulary: word pattern and word end.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
WORD_END = "</w>"
SEPARATORS = frozenset("\x1c\x1d\x1e\x1f")
WHITE = regex.compile(r"\p{White_Space}+")
#: Fragments and words that a task remembers before it starts afresh.
REMEMBERED = 300_000
#: Longest of those, so that what is remembered has a size; longer ones are rare and worked out again.
LONGEST = 64
#: Symbols from which a fragment's pairs are kept in a heap; below, looking through all of them is quicker.
LONG = 128


def little_endian(ids: list[int]) -> bytes:
    """ids as unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Codec:
    """Encoder and decoder of a vocabulary file of the word-end BPE kind."""

    def __init__(self, content: str):
        file = json.loads(content)
        vocab: dict[str, int] = file["model"]["vocab"]
        rest = iter(range(256, 512))
        plain = set(PLAIN_BYTES)
        self.letters = [chr(b) if b in plain else chr(next(rest)) for b in range(256)]
        byte_of = {c: b for b, c in enumerate(self.letters)}
        self.vocab = vocab
        merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        self.size = len(vocab)
        self.ranks = {vocab[x] * self.size + vocab[y]: i for i, (x, y) in enumerate(merges)}  # by the ids of the pair
        self.merged = [vocab[x + y] for x, y in merges]
        self.single = [vocab[c] for c in self.letters]
        self.final = [vocab[c + WORD_END] for c in self.letters]
        self.special_ids = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens = {i: t for t, i in (vocab | self.special_ids).items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.special_ids)) + ")")
        self.pattern = regex.compile(PATTERN)
        self.inside = bytearray(1 << 16)  # byte pairs that occur inside a token
        for token in vocab:
            b = [byte_of[c] for c in token.removesuffix(WORD_END)]
            for x, y in zip(b, b[1:], strict=False):
                self.inside[x << 8 | y] = 1
        self.fragments: dict[tuple[bytes, bool], list[int]] = {}
        self.words: dict[str, bytes] = {}

    def fragment(self, piece: bytes, last: bool) -> list[int]:
        """Ids of one fragment: the leftmost pair of the lowest rank is merged until no pair has a rank."""
        symbols = [self.single[b] for b in piece]
        if last:
            symbols[-1] = self.final[piece[-1]]
        if len(symbols) > LONG:
            return self.long_fragment(symbols)
        rank, size, none = self.ranks.get, self.size, len(self.merged)
        ranks = [rank(x * size + y, none) for x, y in zip(symbols, symbols[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            symbols[i : i + 2] = [self.merged[best]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(symbols[i] * size + symbols[i + 1], none)
            if i:
                ranks[i - 1] = rank(symbols[i - 1] * size + symbols[i], none)
        return symbols

    def long_fragment(self, symbols: list[int]) -> list[int]:
        """The same with a heap of pairs, so that time stays near the length for runs of any length."""
        rank, size, end = self.ranks.get, self.size, len(symbols)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(r, i) for i in range(end - 1) if (r := rank(symbols[i] * size + symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j == end or rank(symbols[i] * size + symbols[j]) != r:
                continue  # one of the pair is merged already
            symbols[i], symbols[j] = self.merged[r], -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) < end and (r := rank(symbols[x] * size + symbols[y])) is not None:
                    heapq.heappush(heap, (r, x))
        return [x for x in symbols if x >= 0]

    def cuts(self, word: bytes) -> list[bytes]:
        """Fragments of a word, cut wherever no token could reach across."""
        inside = self.inside
        at = [i for i, (x, y) in enumerate(zip(word, word[1:], strict=False), 1) if not inside[x << 8 | y]]
        return [word[i:j] for i, j in zip([0, *at], [*at, len(word)], strict=True)]

    def word(self, raw: str) -> bytes:
        """Ids of a part without ASCII white space, as little-endian unsigned 32-bit integers."""
        text = unicodedata.normalize("NFC", raw).replace("Σ", "σ").lower()
        ids: list[int] = []
        for token in self.pattern.findall(text):
            parts = self.cuts(token.encode())
            for k, part in enumerate(parts):
                key = (part, k == len(parts) - 1)
                if (got := self.fragments.get(key)) is None:
                    if len(self.fragments) > REMEMBERED:
                        self.fragments.clear()
                    got = self.fragment(*key)
                    if len(part) <= LONGEST:
                        self.fragments[key] = got
                ids.extend(got)
        return little_endian(ids)

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        if "<|" in text and self.special.search(text):
            return b"".join(little_endian([self.special_ids[s]]) if s in self.special_ids else self.encode(s) for s in self.special.split(text) if s)
        out, words = [], self.words
        # str.split() also cuts at four control characters that are no white space to the vocabulary's pattern
        for w in text.split() if SEPARATORS.isdisjoint(text) else filter(None, WHITE.split(text)):
            if (got := words.get(w)) is None:
                if len(words) > REMEMBERED:
                    words.clear()
                got = self.word(w)
                if len(w) <= LONGEST:
                    words[w] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids) -> str:
        """The text of ids, special tokens included, with a blank between tokens as this vocabulary has no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


def _run(docs: DataFrame, vocabulary: str, schema: str, rows) -> DataFrame:
    with open(vocabulary, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(content.value)
        for batch in batches:
            yield rows(codec, batch)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) of every document. vocabulary: a local path of the driver."""

    def rows(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.frombuffer(codec.encode(t or ""), "<u4").astype(np.int32) for t in batch.column("text").to_pylist()]
        n = [len(x) for x in ids]
        flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
        arrays = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), flat)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), arrays], ["doc_id", "n_tokens", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _run(docs.select("doc_id", "text"), vocabulary, f"doc_id {kind}, n_tokens long, ids array<int>", rows)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text decoded from ids. Null ids decode to the empty text."""

    def rows(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [codec.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return _run(encoded.select("doc_id", "ids"), vocabulary, f"doc_id {kind}, text string", rows)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, decode and digest in one pass over the text."""

    def rows(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        n, ids_sha, text_sha = [], [], []
        for t in batch.column("text").to_pylist():
            raw = codec.encode(t or "")
            n.append(len(raw) // 4)
            ids_sha.append(hashlib.sha256(raw).hexdigest())
            text_sha.append(hashlib.sha256(codec.decode(np.frombuffer(raw, "<u4").tolist()).encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _run(docs.select("doc_id", "text"), vocabulary, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)
