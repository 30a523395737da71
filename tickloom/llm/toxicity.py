"""Toxicity: cumulative-link ordinal regression from sparse text features to a severity grade.

Features of a text are the hashed words (lower-cased, cut at white space and ASCII
punctuation) and the hashed beginnings of words, each present or absent. One weight vector is
shared by the ordered thresholds: P(grade <= j) = sigmoid(threshold_j - weights . features).
The result is the expected grade, sum over j of P(grade > j).

Labels here say toxic or not. Grade 0 is not toxic; toxic training texts get grades 1 to
``GRADES - 1`` by equal parts of their summed log-odds evidence.

The model is fitted on a bounded sample of labelled rows (``MAX_PER_CLASS`` of each class, chosen
by the hash of the id); every text is scored.

Defined results: a null or empty text has no feature and gets the grade of such a text; several
labels of one id count as the highest; labels without a text and null labels are not used; without
labels of both classes every text gets severity 0 and is not toxic. Repeated rows get equal results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import LOWER, SPACE, Lookup, Words, lowered, mix, pieces, saved, signed, table, utf8

#: Most labelled texts of each class that the model is fitted on.
MAX_PER_CLASS = 6_000
#: Most features with a weight, least toxic texts that have one, its least z-score, and the least part of the highest z-score
#: (words of one much copied text have low ones).
MAX_FEATURES, LEAST_TEXTS, LEAST_Z, LEAST_PART = 4096, 3, 4.0, 0.2
PREFIXES = (4, 5, 6)
GRADES = 4
#: A text is toxic when P(grade > 0) is at least this.
THRESHOLD = 0.3
STEPS, RATE, PENALTY = 1000, 0.2, 1e-6

_cut = SPACE.copy()
_cut[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of words and word beginnings, with repeats."""
    words = Words(data, offsets, LOWER, _cut)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    hashes, owners = [words.hashes()], [owner]
    for k in PREFIXES:
        long = words.end - words.start > k
        start = words.start[long]
        hashes.append(mix(words.span_hash(start, start + k) + np.uint64(k)))
        owners.append(owner[long])
    return np.concatenate(hashes), np.concatenate(owners)


def feature_counts(batches):
    """Task over (text, toxic): (feature, toxic texts, clean texts), added up within some texts."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for i, j, data, offsets in pieces(*utf8(lowered(batch.column(0))), most=8 << 20):
            h, owner = features(data, offsets)
            order = np.lexsort((owner, h))
            h, owner = h[order], owner[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            h, bad = h[new], toxic[i:j][owner[new]]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(h)))
            n_bad = np.add.reduceat(bad.astype(np.int64), first) if len(h) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed(h[first])), pa.array(n_bad), pa.array(size - n_bad)], names=["feature", "toxic_texts", "clean_texts"])


def present(texts: pa.Array, known: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature position) of the known features of each text, once each, in order."""
    rows, found = [], []
    for i, _, data, offsets in pieces(*utf8(lowered(texts))):
        h, owner = features(data, offsets)
        at = known.find(h)
        hit = at >= 0
        pair = np.unique(owner[hit] * np.int64(len(known.keys) + 1) + at[hit])
        rows.append(i + pair // (len(known.keys) + 1))
        found.append(pair % (len(known.keys) + 1))
    return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *found])


def known_features(keys: np.ndarray):
    def run(batches):
        known = Lookup(keys)
        for batch in batches:
            row, at = present(batch.column(0), known)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32()))], names=["toxic", "at"])

    return run


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(row: np.ndarray, at: np.ndarray, grade: np.ndarray, n_features: int, grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds for 0/1 features given as (row, feature) pairs, by Adam on the mean log loss with a squared penalty."""
    n = len(grade)
    share = np.array([(grade <= j).mean() for j in range(grades - 1)])
    start = np.log((share * n + 0.5) / ((1 - share) * n + 0.5))
    gaps = np.maximum(np.diff(start), 0.1)
    theta = np.concatenate([np.zeros(n_features), start[:1], np.log(np.expm1(gaps))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, free = theta[:n_features], theta[n_features:]
        soft = np.log1p(np.exp(free[1:]))
        cut = np.concatenate([[-np.inf], free[0] + np.concatenate([[0], np.cumsum(soft)]), [np.inf]])
        score = np.bincount(row, w[at], n)
        high, low = cut[grade + 1] - score, cut[grade] - score
        a, b = _sigmoid(high), _sigmoid(low)
        a[grade == grades - 1], b[grade == 0] = 1, 0
        p = np.maximum(a - b, 1e-9)
        g_score = (1 - a - b) / n
        g_cut = np.bincount(grade + 1, -a * (1 - a) / p, grades + 1) + np.bincount(grade, b * (1 - b) / p, grades + 1)
        tail = np.cumsum(g_cut[1:grades][::-1])[::-1] / n
        grad = np.concatenate([np.bincount(at, g_score[row], n_features) + PENALTY * w, tail[:1], tail[1:] * _sigmoid(free[1:])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    free = theta[n_features:]
    return theta[:n_features], free[0] + np.concatenate([[0], np.cumsum(np.log1p(np.exp(free[1:])))])


def fit(docs: DataFrame, labels: DataFrame, grades: int = GRADES) -> Model:
    """Fit on a bounded sample of the labelled texts of docs (doc_id, text) and labels (doc_id, toxic)."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("boolean").alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = known.where("toxic").orderBy(*order).limit(MAX_PER_CLASS).unionAll(known.where("not toxic").orderBy(*order).limit(MAX_PER_CLASS))
    # at most 2 * MAX_PER_CLASS ids
    texts = saved(docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id").select("text", "toxic").distinct(), "toxicity-sample")
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    bad, good = sizes.get(True, 0), sizes.get(False, 0)
    if not bad or not good:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.full(grades - 1, np.inf))
    counts = texts.mapInArrow(feature_counts, "feature long, toxic_texts long, clean_texts long").groupBy("feature").agg(F.sum("toxic_texts").alias("t"), F.sum("clean_texts").alias("c"))
    share = (F.col("t") + F.col("c")) / (bad + good)
    z = (F.col("t") / bad - F.col("c") / good) / F.sqrt(share * (1 - share) * (1 / bad + 1 / good))
    best = counts.where((F.col("t") >= LEAST_TEXTS) & (share < 1)).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).toArrow()
    best = best.filter(pc.greater_equal(best["z"], LEAST_PART * (pc.max(best["z"]).as_py() or 0)))
    keys = best["feature"].to_numpy().view(np.uint64)
    t, c = best["t"].to_numpy(), best["c"].to_numpy()
    evidence = np.log((t + 0.5) / (bad + 1)) - np.log((c + 0.5) / (good + 1))
    rows = texts.mapInArrow(known_features(keys), "toxic boolean, at array<int>").toArrow().combine_chunks()
    toxic, lists = rows["toxic"].to_numpy(zero_copy_only=False).astype(bool), rows["at"].to_pylist()
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    at = np.array([x for y in lists for x in y], np.int64)
    total = np.bincount(row, evidence[at], len(lists)) if len(at) else np.zeros(len(lists))
    cuts = np.quantile(total[toxic], np.arange(1, grades - 1) / (grades - 1))
    grade = np.where(toxic, 1 + np.searchsorted(cuts, total, "left"), 0)
    return Model(keys, *fit_ordinal(row, at, grade, len(keys), grades))


def scorer(spark: SparkSession, model: Model):
    """A column function: text -> struct(severity, grade, toxic)."""
    shared = spark.sparkContext.broadcast((model.keys, model.weights, model.thresholds))

    @F.arrow_udf("struct<severity:double,grade:int,toxic:boolean>")
    def score(texts: pa.Array) -> pa.Array:
        keys, weights, thresholds = shared.value
        row, at = present(texts, Lookup(keys))
        sums = np.bincount(row, weights[at], len(texts))
        above = _sigmoid(sums[:, None] - thresholds) * np.isfinite(thresholds)
        return pa.StructArray.from_arrays([pa.array(above.sum(1)), pa.array((above >= THRESHOLD).sum(1).astype(np.int32)), pa.array(above[:, 0] >= THRESHOLD)], names=["severity", "grade", "toxic"])

    return score


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", scorer(spark, model)("text").alias("s")).select("doc_id", "s.severity", "s.grade", "s.toxic")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of docs that aren't toxic; columns stay as they are."""
    return docs.where(~scorer(docs.sparkSession, model)(F.col("text"))["toxic"])
