"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of every labelled text in Spark tasks and adds them up by
(language, bucket). The log-probability matrix has a fixed number of buckets and a row for each
language (256 KB), and is broadcast; tasks score whole batches of texts in numpy.

N-grams of one text depend on each other, so its log-likelihoods are divided by 1 + n-grams / ``grain``
before they are made probabilities. ``grain`` is calibrated: of the powers of 2 it is the one with the
least log loss on all labelled texts of the fold that isn't counted (one in ``FOLDS``, by hash).

Defined results: a null text, an empty text or a text without a letter gets ``und`` and score 0.
Rows whose language is null are not learned from. With nothing to learn from, all texts get
``und``. Ties go to the alphabetically first language. Repeated rows count as often as they come.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import crc_of_id, pieces, sums_by_text, table, utf8

ORDERS = (1, 2, 3)
BUCKET_BITS = 16
#: Languages whose counts a task holds before it gives them out.
HELD_LANGUAGES = 128
#: One labelled text in FOLDS calibrates the score instead of being counted; grains to choose from; parts that a log loss is counted in.
FOLDS, GRAINS, LOSS_UNIT = 16, 2.0 ** np.arange(17), 1e-6
#: Added to each count.
SMOOTHING = 0.5
#: A document is kept from this score on.
LEAST_SCORE = 0.5
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of the lower-cased texts that end at each character, a row for each order; where each text begins."""
    raw = data.tobytes()
    texts = [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    place = np.arange(len(chars)) - np.repeat(first[:-1], np.diff(first))
    found = np.empty((len(ORDERS), len(chars)), np.int32)
    with np.errstate(over="ignore"):
        for k, order in enumerate(ORDERS):
            h = np.full(len(chars), order, np.uint32)
            for back in range(order):
                moved = np.zeros(len(chars), np.uint32)
                moved[back:] = chars[: len(chars) - back]
                moved[place < back] = 0  # before the text's beginning
                h = (h ^ moved) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(13)
            found[k] = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
    return found, first


def count_grams(langs: list[str]):
    """A task that gives (language, bucket, n) of its rows of (text, lang)."""

    def run(batches):
        number = {x: i for i, x in enumerate(langs)}
        counts: dict[int, np.ndarray] = {}

        def flush():
            for k, n in counts.items():
                bucket = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), k, np.int32)), pa.array(bucket.astype(np.int32)), pa.array(n[bucket])], names=["lang_no", "bucket", "n"])
            counts.clear()

        for batch in batches:
            of = np.array([number.get(x, -1) for x in batch.column(1).to_pylist()], np.int64)
            for i, j, data, offsets in pieces(*utf8(batch.column(0))):
                found, first = grams(data, offsets)
                owner = np.repeat(of[i:j], np.diff(first))
                for k in np.unique(owner[owner >= 0]).tolist():
                    counts[k] = counts.get(k, 0) + np.bincount(found[:, owner == k].ravel(), minlength=1 << BUCKET_BITS)
                    if len(counts) > HELD_LANGUAGES:
                        yield from flush()
        yield from flush()

    return run


@dataclass
class Model:
    langs: list[str]
    #: natural log of P(bucket | language), a row for each language
    matrix: np.ndarray
    prior: np.ndarray
    grain: float = 1.0


def fit(train: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from all rows that have a language."""
    train = train.where(F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = train.groupBy("lang").count().collect()  # a row for each language
    docs = {r["lang"]: r["count"] for r in rows}
    langs = sorted(docs)
    if not langs:
        return Model([], np.zeros((0, 1 << BUCKET_BITS), np.float32), np.zeros(0))
    aside = F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0
    counts = np.zeros((len(langs), 1 << BUCKET_BITS), np.float32)
    sums = train.where(~aside).mapInArrow(count_grams(langs), "lang_no int, bucket int, n long").groupBy("lang_no", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[sums["lang_no"].to_numpy(), sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    counts += SMOOTHING
    total = counts.sum(1, keepdims=True, dtype=np.float64)
    matrix = np.log(counts, out=counts)
    matrix -= np.log(total)
    model = Model(langs, matrix, np.log(np.array([docs[x] for x in langs], float) / sum(docs.values())))
    model.grain = calibrated(model, train.where(aside))
    return model


def logs_of(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log P(language) + log P(text | language) by text and language, n-grams of each text)."""
    found, first = grams(data, offsets)
    logs = np.tile(model.prior, (len(offsets) - 1, 1))
    for k in range(len(model.langs)):
        logs[:, k] += sums_by_text(sum(model.matrix[k].take(row) for row in found), first)
    return logs, len(ORDERS) * np.diff(first)


def shares(logs: np.ndarray, n: np.ndarray, grain: float) -> np.ndarray:
    """Probabilities of the languages."""
    x = logs / (1 + n / grain)[:, None]
    p = np.exp(x - x.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def losses(shared):
    """Task over (text, lang): (grain, loss, n), the summed log loss with each of GRAINS, in LOSS_UNIT, and the texts."""

    def run(batches):
        model, total, texts = shared.value, np.zeros(len(GRAINS), np.int64), 0
        number = {x: i for i, x in enumerate(model.langs)}
        for batch in batches:
            of = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for i, j, data, offsets in pieces(*utf8(batch.column(0))):
                logs, n = logs_of(model, data, offsets)
                for k, grain in enumerate(GRAINS):
                    p = shares(logs, n, grain)[np.arange(j - i), of[i:j]]
                    total[k] += np.rint(-np.log(np.maximum(p, 1e-9)) / LOSS_UNIT).astype(np.int64).sum()
            texts += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(GRAINS), pa.array(total), pa.array(np.full(len(GRAINS), texts))], names=["grain", "loss", "n"])

    return run


def calibrated(model: Model, held: DataFrame) -> float:
    """The grain with the least log loss on the rows of held (text, lang), the least of equal ones; 1 without rows."""
    shared = held.sparkSession.sparkContext.broadcast(model)
    sums = held.select("text", "lang").mapInArrow(losses(shared), "grain double, loss long, n long").groupBy("grain").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"))
    found = sums.collect()  # a row for each grain
    shared.unpersist()
    return min(((r["loss"] // r["n"], r["grain"]) for r in found if r["n"]), default=(0, 1.0))[1]


def predictor(spark: SparkSession, model: Model):
    """A column function: text -> struct(lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        own = shared.value
        pred, score = np.full(len(texts), -1, np.int64), np.zeros(len(texts))
        whole, bounds = utf8(texts)
        for i, j, data, offsets in pieces(whole, bounds) if own.langs else ():
            logs, n = logs_of(own, data, offsets)
            raw = data.tobytes()
            letters = np.array([LETTER.search(raw[a:b].decode("utf-8", "replace")) is not None for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            pred[i:j] = np.where(letters, logs.argmax(1), -1)
            score[i:j] = np.where(letters, shares(logs, n, own.grain).max(1), 0)
        names = pa.array([*own.langs, UNKNOWN], pa.string())
        return pa.StructArray.from_arrays([names.take(pa.array(np.where(pred < 0, len(own.langs), pred))), pa.array(score)], names=["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """struct(lang_pred, score) of a text column of docs."""
    return predictor(docs.sparkSession, model)(F.col(text))


def held_out() -> Column:
    return crc_of_id() % 3 == 1


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return docs.select("doc_id", held_out().alias("held_out"), identify(docs, model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """Rows of docs with a known language of at least that score; columns stay as they are."""
    found = identify(docs, model)
    return docs.where((found["lang_pred"] != UNKNOWN) & (found["score"] >= least))
