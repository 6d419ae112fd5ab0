"""Corpus pipeline: documents that remain for training, in stages that each call one operator.

Each stage gets the documents that the one before it kept. All but the last return the columns of documents; n_chars
follows the text where a stage changes it. The last returns the encoding of what is left.

Null and empty texts are not toxic, have no lines, no near duplicates and no benchmark items, and are encoded to nothing,
so they stay. Repeated rows: equal lines of one document id and text stay in all of its rows or go in all, rows of one
doc_id are told apart by their texts, so each is a near duplicate, or holds a benchmark item, for itself; rows alike in both
stay or go together. Rows without a doc_id are never removed as duplicates. Ties go to the smallest doc_id. Extra columns pass through all stages but the last
with their values, whatever their names. Texts are read whole. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import bpe, decontam, jaccard, lines, toxicity
from terrane.llm.shared import save


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores at 0.5 or more go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, "toxicity__").where("toxicity__ < 0.5").drop("toxicity__")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with an earlier equal or nearly equal line go; so do documents that have no line left but had one."""
    own = {c: lines.free(docs, f"{c}__") for c in docs.columns if c.lower() in ("n_lines", "n_removed")}  # the counts would take their place
    rows = lines.dedup(docs.withColumnsRenamed(own)).where((F.col("n_removed") == 0) | ~lines.blank("text"))
    rows = rows.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows whose doc_id and hash of the text are in gone (gone_id, gone_h)."""
    gone = gone.distinct()
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_h"]), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id."""
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("gone_h"))
    found = jaccard.similar(marked, n=5, percent=80, mark="gone_h").where("doc_id <> component_id")
    return without(docs, found.select(F.col("doc_id").alias("gone_id"), "gone_h"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    key = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("h")))
    found = decontam.contained(docs.select(key.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.select(F.col("doc_id.doc_id").alias("gone_id"), F.col("doc_id.h").alias("gone_h")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them."""
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", reject_toxic), ("line_dedup", drop_repeated_lines), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("bpe", encode)]
#: The first stage is a trained network, the last a tokenizer: beyond SQL. tests/llm/test_pipeline_stages.py runs every stage
#: and run() on a fixture with rows worked out by hand and the tokenizers library; the operators have brute-force tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
