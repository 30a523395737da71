"""Token counts: an exact histogram of encoded lengths that answers questions about every context limit.

Documents are counted by their number of ids. Suffix sums over the lengths give, for each length
that occurs as a limit: documents and ids of documents at least that long, ids that remain when
each document is cut to the limit, and the share of documents that aren't longer. Limits between
two lengths follow from their neighbours (``at_limit``), quantiles from the shares (``quantile``).

The suffix sums have two levels, within ranges of ``RANGE`` lengths and over the ranges, so that no
task holds more than one range or one row for each range.

Defined results: null texts are empty and have length 0; an empty table gives no rows; a quantile
of it is null. Repeated rows count as often as they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.bpe import lengths
from tickloom.llm.common import saved, table
from tickloom.llm.token_files import tokenizer_path

RANGE = 4096


def histogram(docs: DataFrame, path: str) -> DataFrame:
    """(n_tokens, docs): how many documents have each encoded length."""
    return lengths(docs.select("text"), path).groupBy("n_tokens").agg(F.count("*").alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Each length with docs_at_least, tokens_at_least, tokens_kept (documents cut to it), share_at_most, of_docs and of_tokens."""
    own = hist.withColumn("part", F.floor(F.col("n_tokens") / RANGE)).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    parts = own.groupBy("part").agg(F.sum("docs").alias("part_docs"), F.sum("tokens").alias("part_tokens"))
    later = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(1, Window.unboundedFollowing)  # one row for each range
    every = Window.partitionBy(F.lit(0))
    parts = parts.select(
        F.col("part"), F.coalesce(F.sum("part_docs").over(later), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("part_tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("part_docs").over(every).alias("of_docs"), F.sum("part_tokens").over(every).alias("of_tokens"),
    )
    from_here = Window.partitionBy("part").orderBy("n_tokens").rowsBetween(0, Window.unboundedFollowing)
    found = own.join(parts, "part").select(
        "n_tokens", "docs", (F.sum("docs").over(from_here) + F.col("later_docs")).alias("docs_at_least"), (F.sum("tokens").over(from_here) + F.col("later_tokens")).alias("tokens_at_least"), "of_docs", "of_tokens"
    )
    kept = F.col("of_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    return found.select("n_tokens", "docs", "docs_at_least", "tokens_at_least", kept.alias("tokens_kept"), ((F.col("of_docs") - F.col("docs_at_least") + F.col("docs")) / F.col("of_docs")).alias("share_at_most"), "of_docs", "of_tokens")


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """One row: documents longer than the limit, and the ids that remain when all documents are cut to it."""
    longer = F.col("n_tokens") > limit
    tokens, docs = F.coalesce(F.max(F.when(longer, F.col("tokens_at_least"))), F.lit(0)), F.coalesce(F.max(F.when(longer, F.col("docs_at_least"))), F.lit(0))
    return sums.agg(docs.alias("docs_over"), (F.max("of_tokens") - tokens + docs * limit).alias("tokens_kept"))


def quantile(sums: DataFrame, share: float) -> DataFrame:
    """One row: the smallest length that at least this share of the documents doesn't exceed."""
    return sums.where(F.col("share_at_most") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = saved(histogram(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")), "lengths")  # read twice: a row for each length
    return suffix_sums(hist)
