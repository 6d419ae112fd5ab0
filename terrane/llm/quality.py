"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger row holds the measurements and one failure bit per rule; a
policy is a mask of bits (and its version), so applying a policy, changing it, or asking what one rule costs needs
only bitwise work on the ledger and never the text again.

Nulls and empty texts have zero words and fail ``few_words``. Repeated rows each get a ledger row. Texts of any
length are read whole. Other columns of the input are ignored. An empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.text import BASES, Powers, passes, utf8, windows, word_hashes, words

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, "
    "n_upper long, n_letters long, n_digits long, n_distinct_words long"
)
#: name -> SQL condition of failure over the measurements. The place in this list is the bit; append only.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeats", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "n_symbols > 0.1 * n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    ("dup_lines", "n_lines > 3 AND n_dup_lines > 0.3 * n_lines"),
    ("shouting", "n_letters > 0 AND n_upper > 0.5 * n_letters"),
    ("digits", "n_digits > 0.3 * word_chars"),
    ("poor_vocabulary", "n_words >= 50 AND n_distinct_words < 0.1 * sqrt(n_words) * sqrt(50)"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Versioned policies: the rules that a document may not fail.
POLICIES = {
    "base": ("few_words", "repeats"),
    "v1": ("few_words", "repeats", "symbols", "word_length", "dup_lines", "shouting", "digits", "poor_vocabulary"),
    "v2": ("few_words", "repeats", "symbols", "word_length", "shouting", "digits"),  # poetry and tables may repeat lines and words
}
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams, one = Powers(BASES[1]), Powers(BASES[0])
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        out = []
        for i, j in passes(offsets):
            d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            n = j - i
            starts, ends, w = words(d, o)
            doc = np.repeat(np.arange(n), np.diff(w))

            def per_doc(flags, o=o):
                sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
                return sums[o[1:]] - sums[o[:-1]]

            heads = (d & 0xC0) != 0x80  # first bytes of code points
            white = (d == 32) | ((d >= 9) & (d <= 13))
            h = word_hashes(d, starts, ends, one)
            # words in 3-word windows found twice or more in their document
            first, g = windows(h, w, 3, grams)
            key_doc = doc[first]
            order = np.lexsort((g, key_doc))
            same = (g[order][1:] == g[order][:-1]) & (key_doc[order][1:] == key_doc[order][:-1])
            twice = np.zeros(len(first), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(len(h) + 3, bool)
            for k in range(3):
                covered[first[twice] + k] = True
            repeat = np.bincount(doc[covered[: len(h)]], minlength=n)
            # lines with a word that equal an earlier line of their document
            newline = d == 10
            inside = o[1:-1]
            line_start = np.unique(np.concatenate([o[:-1], np.flatnonzero(newline) + 1, inside]))
            line_start = line_start[line_start < len(d)] if len(d) else line_start[:0]
            line_end = np.concatenate([line_start[1:], [len(d)]])
            line_end = line_end - ((line_end > line_start) & newline[np.maximum(line_end, 1) - 1] if len(d) else 0)
            line_doc = np.searchsorted(o, line_start, "right") - 1
            with_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
            line_start, line_end, line_doc = line_start[with_word], line_end[with_word], line_doc[with_word]
            lh = word_hashes(d, line_start, line_end, one)
            order = np.lexsort((lh, line_doc))
            again = (lh[order][1:] == lh[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
            dup = np.bincount(line_doc[order][1:][again], minlength=n)
            order = np.lexsort((h, doc))
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
            upper = (d >= 65) & (d <= 90)
            letters = upper | ((d >= 97) & (d <= 122))
            digits = (d >= 48) & (d <= 57)
            out.append([np.diff(w), per_doc(heads & ~white), per_doc(SYMBOLS[d]), dup, repeat, np.bincount(line_doc, minlength=n), per_doc(upper), per_doc(letters), per_doc(digits), np.bincount(doc[order][new], minlength=n)])
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [[]] * 10
        names = [x.split()[0] for x in MEASURES.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in columns)], ["doc_id", *names])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_measure, f"doc_id {kind}, {MEASURES}")


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``failed``, the bits of the rules that the document fails."""
    bits: Column = F.lit(0).cast("long")
    for name, condition in RULES:
        bits = bits + F.when(F.expr(condition), F.lit(BIT[name])).otherwise(0).cast("long")
    return measure(docs).withColumn("failed", bits)


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def passes_policy(policy: str, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents that fail it, fail only it, and pass once it is dropped.

    The ledger is first aggregated to its distinct bit patterns (2**rules at most), whatever the number of rows.
    """
    m = mask(policy)
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    bit = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[policy])))
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).alias
    return (
        patterns.select("bits", "n", bit.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            total(F.col("bits").bitwiseAND(F.col("r.bit")) != 0)("n_failed"),
            total(F.col("bits") == F.col("r.bit"))("n_failed_alone"),
            total(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0)("n_kept_without"),
        )
    )
