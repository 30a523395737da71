"""Language-model scores: a log-bilinear neural model trained with noise-contrastive estimation.

Words are counted over all training documents in Spark. The most frequent ones get vectors; the
predicted vector of a position is the sum of the two words before it, each scaled by position
weights, and a word's score is its inner product with the predicted vector plus a bias. Training is
data-parallel: the training documents of each of ``ROUNDS`` rounds (each document is in one) are dealt by
their ids and texts to shards, whose number follows from the bytes of text, and sorted there, so that
another split of the same table gives the same model. Every shard starts from the broadcast parameters and
takes gradient steps of noise-contrastive estimation; the parameters of all shards are averaged, weighted
by their words. Scores are normalised exactly: exp(score) is a product of a factor for each context
word, so one matrix product of the two factor tables gives the normaliser of every context.

The ``SINGLES`` most frequent words have vectors of their own; all others are dealt to classes with a
vector each, words with a broadcast count by their rank, the rest by their hash, so that a class holds
mostly one of the next frequent words. Within its class, smoothed counts give a word's probability. There
are ``SPREAD`` classes for each unit of the cube root of the number of distinct words: vectors grow with
the corpus, and the tables of scores (vectors squared) stay below it: a billion distinct words give 7,024
vectors and three tables of 200 MB.

Counts of the ``HEAD`` most frequent words are broadcast, a fixed number; counts of all others are
joined by shuffling word hashes (64 bits).

Defined results: null texts are empty and hold only the end token; a null id isn't held out;
without training documents all probabilities come from the smoothing alone. Repeated rows get equal
results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import END_HASH, Lookup, Words, crc_of_id, forget, pieces, saved, signed, sums_by_text, table, utf8

#: Words with a broadcast count; of them, words with a vector of their own (id 0 is the end).
HEAD, SINGLES = 1 << 18, 1024
#: Classes of all other words, for each unit of the cube root of the number of distinct words.
SPREAD = 6
#: Bytes of training text in a shard, about.
SHARD_BYTES = 8 << 20
SIZE, ROUNDS = 20, 4
BATCH, NOISE, RATE = 1024, 48, 0.15
#: Word hashes that a counting task sorts at once.
FLUSH = 1 << 22
SMOOTHING = 0.5


def words_and_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and of its end, and where each text's begin."""
    words = Words(data, offsets)
    return np.insert(words.hashes(), words.first[1:], END_HASH), words.first + np.arange(len(words.first))


def count_words(batches):
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n)], names=["h", "n"])

    for batch in batches:
        for _, _, data, offsets in pieces(*utf8(batch.column(0))):
            held.append(words_and_ends(data, offsets)[0])
            if sum(map(len, held)) >= FLUSH:
                yield flush()
    if held:
        yield flush()


@dataclass
class Counts:
    """Corpus counts: a table (h, n) of all words, its sums, and the head."""

    table: DataFrame
    tokens: int
    kinds: int
    head: np.ndarray
    head_n: np.ndarray
    #: occurrences and kinds of the words of each class, whose number grows with the kinds of all words
    class_n: np.ndarray
    class_kinds: np.ndarray


def classes_for(kinds: int) -> int:
    return max(1, round(SPREAD * kinds ** (1 / 3)))


def ids_of(at: np.ndarray, h: np.ndarray, classes: int) -> np.ndarray:
    """The vector of each word, by its place in the head (or -1) and its hash."""
    of_rest = np.where(at < 0, (h >> np.uint64(20)).astype(np.int64), at) % classes
    return np.where((at >= 0) & (at < SINGLES), at, SINGLES + of_rest)


def count(train: DataFrame) -> Counts:
    counts = saved(train.select("text").mapInArrow(count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "word-counts")
    total = counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("kinds")).first()
    head = counts.orderBy(F.desc("n"), "h").limit(HEAD).toArrow()
    h, n = head["h"].to_numpy().view(np.uint64), head["n"].to_numpy()
    if not (h == END_HASH).any():
        h, n = np.append(h, END_HASH), np.append(n, 0)
    first = np.argsort(h != END_HASH, kind="stable")  # the end comes first
    h, n = h[first], n[first]
    classes = classes_for(total["kinds"])
    of_hash = F.pmod(F.shiftrightunsigned("h", 20), F.lit(classes)).cast("int").alias("class")
    rest = counts.groupBy(of_hash).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toArrow()  # a row for each class
    class_n, class_kinds = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    class_n[rest["class"].to_numpy()], class_kinds[rest["class"].to_numpy()] = rest["n"].to_numpy(), rest["kinds"].to_numpy()
    # words of the head leave the class of their hash; those without a vector of their own enter that of their rank
    seen = n > 0
    own = (h >> np.uint64(20)).astype(np.int64) % classes
    np.subtract.at(class_n, own, n)
    np.subtract.at(class_kinds, own, seen)
    rank = np.arange(SINGLES, len(h))
    np.add.at(class_n, rank % classes, n[rank])
    np.add.at(class_kinds, rank % classes, seen[rank])
    return Counts(counts, total["tokens"] or 0, total["kinds"], h, n, class_n, class_kinds)


# The neural model. Parameters in one vector: context vectors, word vectors, position weights, biases, and their squared-gradient sums.


def shapes(vectors: int) -> dict[str, tuple[int, ...]]:
    return {"context": (vectors, SIZE), "word": (vectors, SIZE), "position": (2, SIZE), "bias": (vectors,)}


def split(flat: np.ndarray, vectors: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(vectors).items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def start(p: np.ndarray) -> np.ndarray:
    """First parameters for words of probability p: the score is the log probability of the word alone."""
    rng = np.random.default_rng(3)
    n = len(p)
    flat = np.concatenate([rng.normal(0, 0.1, n * SIZE), rng.normal(0, 0.1, n * SIZE), np.ones(2 * SIZE), np.log(p)])
    return np.concatenate([flat, np.full(len(flat), 1e-3)]).astype(np.float32)


def add_rows(to: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """to[rows] += values, rows with repeats."""
    order = np.argsort(rows, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(rows[order]) != 0]))
    to[rows[order][first]] += np.add.reduceat(values[order], first)


def train_batch(state: np.ndarray, vectors: int, before: np.ndarray, last: np.ndarray, word: np.ndarray, noise: np.ndarray, log_kp: np.ndarray) -> None:
    """One step of noise-contrastive estimation, with Adagrad, on words after (before, last)."""
    half = len(state) // 2
    m = split(state[:half], vectors)
    g = np.zeros(half, np.float32)
    d = split(g, vectors)
    c1, c2 = m["context"][last], m["context"][before]
    predicted = c1 * m["position"][0] + c2 * m["position"][1]
    own = m["word"][word]
    gain = (predicted * own).sum(1) + m["bias"][word] - log_kp[word]
    e_own = -1 / (1 + np.exp(np.clip(gain, -30, 30)))
    other = m["word"][noise]
    e_noise = 1 / (1 + np.exp(-np.clip(predicted @ other.T + (m["bias"] - log_kp)[noise], -30, 30)))
    d_predicted = e_own[:, None] * own + e_noise @ other
    add_rows(d["word"], word, e_own[:, None] * predicted)
    add_rows(d["word"], noise, e_noise.T @ predicted)
    d["bias"] += np.bincount(word, e_own, vectors) + np.bincount(noise, e_noise.sum(0), vectors)
    add_rows(d["context"], last, d_predicted * m["position"][0])
    add_rows(d["context"], before, d_predicted * m["position"][1])
    d["position"][0], d["position"][1] = (c1 * d_predicted).sum(0), (c2 * d_predicted).sum(0)
    g /= len(word)
    state[half:] += g * g
    state[:half] -= RATE * g / np.sqrt(state[half:])


def contexts(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(second to last, last) id before each position; the end's id stands before a text."""
    place = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))
    last, before = np.zeros_like(ids), np.zeros_like(ids)
    last[1:], before[2:] = ids[:-1], ids[:-2]
    last[place < 1], before[place < 2] = 0, 0
    return before, last


def train_part(shared, number: int):
    """Task: the parameters after its shard of a round, and its words, as one row (state, weight)."""

    def run(batches):
        keys, p, state = shared.value
        vectors = len(p)
        known, state = Lookup(keys), state.copy()
        rng = np.random.default_rng([number, TaskContext.get().partitionId()])  # the shard's number
        log_kp = (np.log(p) + np.log(NOISE)).astype(np.float32)
        cumulated = np.cumsum(p)
        seen = 0
        for batch in batches:
            for _, _, data, offsets in pieces(*utf8(batch.column(0))):
                h, first = words_and_ends(data, offsets)
                ids = ids_of(known.find(h), h, vectors - SINGLES)
                before, last = contexts(ids, first)
                order = rng.permutation(len(ids))
                for at in range(0, len(ids), BATCH):
                    own = order[at : at + BATCH]
                    noise = np.minimum(np.searchsorted(cumulated, rng.random(NOISE) * cumulated[-1]), vectors - 1)
                    train_batch(state, vectors, before[own], last[own], ids[own], noise, log_kp)
                seen += len(ids)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([state.tobytes()], pa.binary()), pa.array([seen], pa.int64())], names=["state", "weight"])

    return run


def weighted_sums(batches):
    """Task over rows of train_part: the sum of their parameters times their words, as (at, value, weight)."""
    total, weight = None, 0
    for batch in batches:
        for state, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(state.as_buffer(), np.float32).astype(np.float64) * n
            total = own if total is None else total + own
            weight += n
    if weight:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), weight, np.int64))], names=["at", "value", "weight"])


@dataclass
class Model:
    counts: Counts
    p: np.ndarray
    #: the parameters; None for counts alone, which give no score
    state: np.ndarray | None


def counted(train: DataFrame) -> Model:
    """The counts of all words of train (text), without a trained model."""
    counts = count(train)
    n = np.zeros(SINGLES)
    n[: len(counts.head_n)] = counts.head_n[:SINGLES]
    p = np.concatenate([n, counts.class_n]) + SMOOTHING
    p /= p.sum()
    return Model(counts, p, None)


def fit(train: DataFrame) -> Model:
    """Count all words of train (doc_id, text) and train on all its documents."""
    spark, model = train.sparkSession, counted(train)
    counts, p = model.counts, model.p
    state = start(p)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS))
    size = train.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = int(max(1, -(-size // (ROUNDS * SHARD_BYTES))))
    for number in range(ROUNDS):
        shared = spark.sparkContext.broadcast((counts.head, p, state))
        own = train.where(part == number).withColumn("text_hash", F.xxhash64("text"))
        dealt = own.repartition(shards, "text_hash", "doc_id").sortWithinPartitions("doc_id", "text_hash")
        # 328 bytes a vector for each shard; reading packs some thirty of them into a task, which sums them first
        states = saved(dealt.select("text").mapInArrow(train_part(shared, number), "state binary, weight long"), "shard-states")
        sums = states.mapInArrow(weighted_sums, "at int, value double, weight long").groupBy("at").agg((F.sum("value") / F.sum("weight")).alias("value")).toArrow()
        forget(states)
        # as many rows as the model has parameters
        if sums.num_rows:
            state[sums["at"].to_numpy()] = sums["value"].to_numpy()
        shared.unpersist()
    return Model(counts, p, state)


def tables(state: np.ndarray, vectors: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores by (last, word) with the bias, scores by (before, word), and log normalisers by (before, last)."""
    m = split(state[: len(state) // 2].astype(np.float32), vectors)
    near = (m["context"] * m["position"][0]) @ m["word"].T + m["bias"]
    far = (m["context"] * m["position"][1]) @ m["word"].T
    top_near, top_far = near.max(1, keepdims=True), far.max(1, keepdims=True)
    after_last = np.exp(near - top_near).T
    norm = np.empty_like(near)
    for at in range(0, vectors, BATCH):  # contexts at once
        part = slice(at, at + BATCH)
        norm[part] = np.log(np.exp(far[part] - top_far[part]) @ after_last) + top_far[part] + top_near.T
    return near, far, norm


def score_part(shared):
    """Task over (doc_id, held_out, text): what a document's head words give, and the hashes of its other words."""

    def run(batches):
        head, head_n, vectors, state, tokens, kinds, class_n, class_kinds = shared.value
        known = Lookup(head)
        near, far, norm = tables(state, vectors) if state is not None else (None, None, None)
        log_n = np.log10(head_n + SMOOTHING)
        base_norm = np.log10(tokens + SMOOTHING * (kinds + 1))
        class_norm = np.log10(np.concatenate([np.ones(SINGLES), class_n + SMOOTHING * (class_kinds + 1)]))
        for batch in batches:
            for i, j, data, offsets in pieces(*utf8(batch.column(2))):
                h, first = words_and_ends(data, offsets)
                at = known.find(h)
                tail = at < 0
                ids = ids_of(at, h, vectors - SINGLES)
                if state is None:
                    model = np.full(len(ids), np.nan)
                else:
                    before, last = contexts(ids, first)
                    model = ((near[last, ids] + far[before, ids] - norm[before, last]) / np.log(10)).astype(np.float64)
                    model -= class_norm[ids]
                of_head = np.where(tail, 0.0, log_n[at])
                other = np.where(ids >= SINGLES, of_head, 0.0)
                n = np.diff(first)
                n_tail = sums_by_text(tail, first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i:j], batch.column(1)[i:j], pa.array(n), pa.array(sums_by_text((head_n[at] > 0) & ~tail, first)),
                        pa.array(sums_by_text(of_head, first) - n * base_norm), pa.array(sums_by_text(model + other, first)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_tail)]), pa.int32()), pa.array(signed(h[tail]))),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base", "model", "tail"],
                )

    return run


#: A word of over 1 / HOT of the words to look up, and of HOT at least, is hot: there are fewer than HOT of them.
HOT = 1000


def with_counts(tail: DataFrame, table: DataFrame, total: int) -> DataFrame:
    """tail (row, h) with the words' counts n of table (h, n), null without one; hot words get theirs by broadcast, so none brings its rows together."""
    words = tail.groupBy("h").agg(F.count("*").alias("times")).join(table.select("h", "n"), "h", "left")
    is_hot = F.col("times") > max(HOT, total / HOT)
    hot = F.broadcast(words.where(is_hot).select("h", "n"))
    return tail.join(hot, "h").unionByName(tail.join(hot.select("h"), "h", "left_anti").join(words.where(~is_hot).select("h", "n"), "h"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, held_out, text); the score of counts alone is NaN."""
    counts, vectors = model.counts, len(model.p)
    shared = docs.sparkSession.sparkContext.broadcast((counts.head, counts.head_n, vectors, model.state, counts.tokens, counts.kinds, counts.class_n, counts.class_kinds))
    rows = docs.select("doc_id", "held_out", "text").mapInArrow(score_part(shared), "doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, tail array<long>")
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "scored")  # the row numbers stay as written
    tail = rows.select("row", F.explode("tail").alias("h"))
    found = with_counts(tail, counts.table, rows.agg(F.sum(F.size("tail"))).first()[0] or 0).groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + SMOOTHING)).alias("logs"), F.count("n").alias("known"))
    logs = F.coalesce("logs", F.lit(0.0))
    return rows.drop("tail").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("model") + logs).alias("score"),
    )


def held_out():
    return crc_of_id() % 5 == 1


def op2(spark: SparkSession, sf_dir: str, learn=fit) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = learn(docs.where(~held_out()))
    return score(docs.withColumn("held_out", held_out()), model)
