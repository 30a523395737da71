"""URL filter: host and path rules, and for the rest a character language-model ratio.

Two smoothed variable-order Markov models, one of allowed and one of blocked URLs, give each byte
a probability from the longest context seen, interpolated down to the uniform distribution
(Witten-Bell: a context counts as much as it has distinct successors). A URL's score is the
difference of the log-likelihoods divided by its length; the threshold is calibrated on labelled
URLs held out of the training.

Learning: URLs that a rule decides, at most ``MAX_PER_CLASS`` of each verdict (chosen by hash) of up to
``MAX_BYTES`` bytes each, a quarter of them kept for calibration; all their contexts are kept. Every
URL is judged.

Defined results: a null URL or one without ``://`` has an empty host and path and no rule; a null
or empty URL has score 0 and is allowed. With URLs of only one verdict to learn from, all scores are
0 and allowed. A score at or above the threshold means allow. Repeated URLs get equal results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import Lookup, forget, pieces, saved, signed, table, utf8

#: (verdict, rule); the longest rule that fits wins.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
MAX_ORDER = 5
#: Most URLs of each verdict that are learned from, and their most bytes: with the orders this bounds the model that is broadcast.
MAX_PER_CLASS, MAX_BYTES = 10_000, 2_048
HELD_OUT = 4

_M = np.uint64(0x9E3779B97F4A7C15)


def parts(url: str = "url") -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path up to ``?`` or ``#``."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule whose host is the URL's or one above it and whose path begins the URL's; else null."""
    chosen = F
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)
        chosen = chosen.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))
    return chosen


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context hashes, hashes of context and byte): a row for each order 0 to MAX_ORDER, a column for each byte. Before a URL stand zeros."""
    n = len(data)
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    context, both = np.empty((MAX_ORDER + 1, n), np.uint64), np.empty((MAX_ORDER + 1, n), np.uint64)
    h = np.zeros(n, np.uint64)
    for order in range(MAX_ORDER + 1):
        if order:
            back = np.zeros(n, np.uint64)
            back[order:] = data[: max(0, n - order)].astype(np.uint64) + np.uint64(1)
            back[place < order] = 0
            h = (h ^ back) * _M
            h ^= h >> np.uint64(29)
        context[order] = (h + np.uint64(order + 1)) * np.uint64(0xBF58476D1CE4E5B9)
        both[order] = ((context[order] ^ (context[order] >> np.uint64(32))) + data + np.uint64(1)) * _M
    return context, both


def count_grams(batches):
    """Task over (url, allowed): (context, both, allowed n, blocked n), added up within the task's batches."""
    for batch in batches:
        allowed = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for i, j, data, offsets in pieces(*utf8(batch.column(0))):
            context, both = grams(data, offsets)
            owner = np.tile(np.repeat(allowed[i:j], np.diff(offsets)), MAX_ORDER + 1)
            keys, first, inverse = np.unique(both.ravel(), return_index=True, return_inverse=True)
            good = np.bincount(inverse.ravel(), owner, len(keys)).astype(np.int64)
            total = np.bincount(inverse.ravel(), minlength=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(signed(context.ravel()[first])), pa.array(signed(keys)), pa.array(good), pa.array(total - good)], names=["context", "gram", "good", "bad"])


class Markov:
    """log P(byte | context) of both models from counts of (context, gram, good, bad)."""

    def __init__(self, context: np.ndarray, gram: np.ndarray, good: np.ndarray, bad: np.ndarray):
        self.gram, self.gram_counts = Lookup(gram), np.stack([np.append(good, 0), np.append(bad, 0)]).astype(np.float64)
        keys, inverse = np.unique(context, return_inverse=True)
        self.context = Lookup(keys)
        self.totals = np.stack([np.append(np.bincount(inverse, n, len(keys)), 0) for n in (good, bad)])
        self.kinds = np.stack([np.append(np.bincount(inverse, n > 0, len(keys)), 0) for n in (good, bad)])

    def ratio(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text: (log-likelihood if allowed - if blocked) / bytes; 0 for an empty one."""
        context, both = grams(data, offsets)
        p = np.full((2, len(data)), 1 / 256)
        for order in range(MAX_ORDER + 1):
            at, of = self.gram.find(both[order]), self.context.find(context[order])
            n, total, kinds = self.gram_counts[:, at], self.totals[:, of], self.kinds[:, of]
            p = np.where(total > 0, (n + kinds * p) / np.maximum(total + kinds, 1), p)
        gain = np.concatenate([[0], np.cumsum(np.log(p[0]) - np.log(p[1]))])
        size = np.diff(offsets)
        return (gain[offsets[1:]] - gain[offsets[:-1]]) / np.maximum(size, 1)


@dataclass
class Model:
    context: np.ndarray
    gram: np.ndarray
    good: np.ndarray
    bad: np.ndarray
    threshold: float


def scorer(spark: SparkSession, model: Model):
    """A column function: url -> score."""
    shared = spark.sparkContext.broadcast((model.context, model.gram, model.good, model.bad))
    kept: list[Markov] = []

    @F.arrow_udf("double")
    def score(urls: pa.Array) -> pa.Array:
        if not kept:
            kept.append(Markov(*shared.value))
        out = np.zeros(len(urls))
        for i, j, data, offsets in pieces(*utf8(urls), most=1 << 18):
            out[i:j] = kept[0].ratio(data, offsets)
        return pa.array(out)

    return score


def threshold(scores: np.ndarray, allowed: np.ndarray) -> float:
    """The cut with the highest mean of the two classes' hit rates; halfway between neighbours, ties to the lower."""
    if not allowed.any() or allowed.all():
        return 0.0
    order = np.argsort(scores, kind="stable")
    s, a = scores[order], allowed[order]
    kept = 1 - np.concatenate([[0], np.cumsum(a)]) / a.sum()
    dropped = np.concatenate([[0], np.cumsum(~a)]) / (~a).sum()
    free = np.concatenate([[True], s[1:] > s[:-1], [True]])
    best = int(np.argmax(np.where(free, kept + dropped, -1)))
    if best in (0, len(s)):
        return float(s[0] - 1e-9 if best == 0 else s[-1] + 1e-9)
    return float((s[best - 1] + s[best]) / 2)


def fit(urls: DataFrame) -> Model:
    """Learn from rows (url, allowed), a bounded number of each verdict."""
    order = (F.xxhash64("url"), F.col("url"))
    known = urls.where((F.octet_length("url") <= MAX_BYTES) & F.col("allowed").isNotNull()).distinct()
    sample = known.where("allowed").orderBy(*order).limit(MAX_PER_CLASS).unionAll(known.where("not allowed").orderBy(*order).limit(MAX_PER_CLASS))
    sample = saved(sample, "url-sample")
    fold = F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(HELD_OUT)) == 0
    counts = sample.where(~fold).mapInArrow(count_grams, "context long, gram long, good long, bad long").groupBy("context", "gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    best = counts.toArrow()  # bounded by the sample
    model = Model(*(best[c].to_numpy().view(np.uint64) for c in ("context", "gram")), *(best[c].to_numpy() for c in ("good", "bad")), 0.0)
    if not model.good.any() or not model.bad.any():
        return Model(*(np.zeros(0, np.uint64) for _ in range(2)), *(np.zeros(0, np.int64) for _ in range(2)), 0.0)
    held = sample.where(fold).select("allowed", scorer(urls.sparkSession, model)("url").alias("score")).toArrow()
    model.threshold = threshold(held["score"].to_numpy(), held["allowed"].to_numpy().astype(bool))
    forget(sample)
    return model


def judge(pages: DataFrame, model: Model, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of pages (page_id, url)."""
    host, path = parts()
    found = pages.select("page_id", host.alias("host"), path.alias("path"), (F.coalesce(F.length("url"), F.lit(0)) == 0).alias("blank"), scorer(pages.sparkSession, model)("url").alias("score"))
    chosen = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("blank") | (F.col("score") >= model.threshold), "allow").otherwise("block")
    return found.select("page_id", "host", "path", chosen["rule"].alias("rule"), F.coalesce(chosen["verdict"], own).alias("verdict"), "score")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").cast("string").alias("url"))
    verdict = rule_of(*parts())["verdict"]
    model = fit(pages.select("url", (verdict == "allow").alias("allowed")))
    return judge(pages, model)
