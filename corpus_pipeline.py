"""The corpus pipeline: five stages over the documents, each written and read again.

Toxic documents go; documents without a known language go; of each group of near duplicates (SimHash)
one document stays; documents that hold a benchmark item go; what is left is encoded with byte-level
BPE and decoded again. Stages but the last return their rows with all columns as they were, extra
columns included.

Defined results: a null, empty or blank text isn't toxic, has no language, and goes at the second
stage, as do texts without a letter. Null ids and repeated ids stay apart by their texts. Repeated rows
fare alike up to the third stage, which keeps one of them. Without labels of both classes no document
is toxic; without languages to learn from none stays; an empty benchmark drops nothing; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import bpe, decontaminate, language, near_copies, toxicity
from tickloom.llm.common import forget, saved, table
from tickloom.llm.token_files import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labels, doesn't call toxic."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted language is known; the model learns from the languages that the stage's documents state."""
    return language.keep_identified(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash fingerprints of five-word shingles in vantage-point trees, Jaccard similarity of 0.8 or more."""
    return near_copies.keep_one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_unmatched(docs, decontaminate.fit(docs, table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, their number, and digests of the ids and of the text decoded from them."""
    path = tokenizer_path("byte_bpe_50k.json")
    found = bpe.encode(docs.select("doc_id", "text"), path)
    return found.select("doc_id", "ids", bpe.digests_udf(path)("ids").alias("r")).select("doc_id", "ids", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("bpe", encode),
]

#: No SQL states these models; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            before, docs = docs, saved(docs, f"pipeline-{name}")
            forget(before)
    return docs
