"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of two halves of ``HALF`` words (lower-cased, cut at white space and ASCII
punctuation), a window beginning at each half. Features are the words of the benchmark items that
tell them apart best, weighted by the inverse frequency of the halves of all documents that have
them. A distributed randomised SVD of the TF-IDF rows of the items and of all corpus halves gives the
latent space: one pass over the documents sums, for each pair of features, the products of how often they
come in a half, and the SVD's products are made from these sums, whose number doesn't grow with the corpus; every window of every document is projected into it, and its
cosine with every item is a blocked matrix product. An item longer than a window is indexed as
passages of about ``PASSAGE`` words, each with a vector of its own. Candidates are checked on their
words: the longest common subsequence with the whole item, and with its answer (its last sentence).

The benchmark is a query set against all documents. A latent space is for about ``PART`` passages, those
of an item together, and directions are added to it until each of them keeps ``KEPT`` of its squared
norm: what the space leaves out lowers the cosine of even an exact copy. Documents are searched for
about ``BLOCK`` passages at once, so what is broadcast is bounded.

Defined results: null and empty texts match nothing, nor do items without words; items of under
``SHORT`` words must be found whole; repeated rows get equal results; an empty benchmark gives no
matches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import CHUNK_BYTES, LOWER, SPACE, Lookup, Words, forget, lowered, pieces, ragged, saved, table, utf8

#: Words of half a window and of a passage of an item that is longer than a window; passages searched for at once (about).
HALF, PASSAGE, BLOCK = 32, 48, 1024
#: Halves whose features' latent vectors are laid out at once; pairs of features whose sums a task holds.
RUN, MOST_PAIRS = 128, 1 << 20
#: Passages of a latent space (about), and the least share of its squared norm that one keeps in it.
PART, KEPT = 256, 0.995
#: Latent dimensions, extra columns and power rounds of the randomised SVD, halves that all those of the corpus together weigh as much as (at most), weight of an item's row.
LATENT, EXTRA, ROUNDS, CORPUS, ITEM_WEIGHT = 256, 16, 2, 20_000, 4.0
#: Least distinct words of an item that become features (half of them, if those are more).
LEAST_FEATURES = 12
#: Least cosine of a candidate; least shares of an item's and its answer's words found in order; items shorter than SHORT must be found whole.
COSINE, SHARE, ANSWER_SHARE, SHORT = 0.35, 0.6, 0.5, 8

_cut = SPACE.copy()
_cut[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(data, offsets, LOWER, _cut)


def halves_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(half of every word, where each text's halves begin)."""
    size = np.diff(first)
    begin = np.concatenate([[0], np.cumsum(-(-size // HALF))])
    place = np.arange(first[-1]) - np.repeat(first[:-1], size)
    return np.repeat(begin[:-1], size) + place // HALF, begin


def lcs(a: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence: a has a bit mask of the n places of each word."""
    full = (1 << n) - 1
    s = full
    for w in words:
        u = s & a.get(w, 0)
        if u:
            s = ((s + u) | (s - u)) & full
    return n - s.bit_count()


def masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


@dataclass
class Items:
    """Some benchmark items; passages are (number of the item, first word, end word)."""

    ids: list
    words: list[list[int]]
    answers: list[list[int]]
    passages: list[tuple[int, int, int]]
    word_masks: list[dict[int, int]] = field(default_factory=list)
    answer_masks: list[dict[int, int]] = field(default_factory=list)
    #: the distinct words of each item, rising
    kinds: list[np.ndarray] = field(default_factory=list)

    def passage_words(self) -> list[np.ndarray]:
        return [np.array(self.words[k][a:b], np.uint64) for k, a, b in self.passages]


def passages_of(n: int) -> list[tuple[int, int]]:
    """First and end words of the passages of an item of n words: itself up to a window, else equal parts of about PASSAGE words."""
    parts = 1 if n <= 2 * HALF else -(-n // PASSAGE)
    return [(n * k // parts, n * (k + 1) // parts) for k in range(parts)]


def read_items(rows: list) -> Items:
    """Items of (item_id, text); the answer is the last sentence."""
    rows = [r for r in rows if r[1]]
    answers = [regex.split(r"(?<=[.!?])\s+", r[1].strip())[-1] for r in rows]

    def hashed(texts: list[str]) -> list[list[int]]:
        words = words_of(*utf8(lowered(pa.array(texts, pa.large_string()))))
        h = words.hashes().tolist()
        return [h[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]

    words, last = hashed([r[1] for r in rows]), hashed(answers)
    kept = [k for k, w in enumerate(words) if w]
    passages = [(j, a, b) for j, k in enumerate(kept) for a, b in passages_of(len(words[k]))]
    items = Items([rows[k][0] for k in kept], [words[k] for k in kept], [last[k] or words[k] for k in kept], passages)
    items.word_masks, items.answer_masks = [masks(w) for w in items.words], [masks(w) for w in items.answers]
    items.kinds = [np.unique(np.array(w, np.uint64)) for w in items.words]
    return items


def count_halves(keys: np.ndarray):
    """Task over texts: (at, n) halves that have each key; at -1: all halves."""

    def run(batches):
        known, counts, total = Lookup(keys), np.zeros(len(keys), np.int64), 0
        for batch in batches:
            for _, words in parts_of(*utf8(lowered(batch.column(0))), 0):
                half, begin = halves_of(words.first)
                total += int(begin[-1])
                at = known.find(words.hashes())
                hit = at >= 0
                pair = np.unique(half[hit] * np.int64(len(keys)) + at[hit])
                counts += np.bincount(pair % len(keys), minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(keys), dtype=np.int32)), pa.array(np.append(total, counts))], names=["at", "n"])

    return run


def added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising distinct keys and the sums of their n."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def feature_pairs(keys: np.ndarray, places: list[np.ndarray], sizes: list[int]):
    """Task over texts: (part, r, c, n): over all halves, the sum of the products of how often the features r <= c of a part come in one.

    places has each part's positions for the keys (-1: none), sizes how many it has."""

    def run(batches):
        known, held = Lookup(keys), [[] for _ in places]

        def given():
            for k, found in enumerate(held):
                if found:
                    key, n = added(*(np.concatenate(x) for x in zip(*found, strict=True)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k, np.int32)), pa.array((key // sizes[k]).astype(np.int32)), pa.array((key % sizes[k]).astype(np.int32)), pa.array(n)], names=["part", "r", "c", "n"])
                found.clear()

        for batch in batches:
            for _, words in parts_of(*utf8(lowered(batch.column(0))), 0):
                half, _ = halves_of(words.first)
                at = known.find(words.hashes())
                hit = at >= 0
                for k, place in enumerate(places):
                    own = place[at[hit]]
                    pair, times = np.unique(half[hit][own >= 0] * np.int64(sizes[k]) + own[own >= 0], return_counts=True)
                    in_half, feature = pair // sizes[k], pair % sizes[k]
                    end = np.searchsorted(in_half, in_half, "right")
                    for a in range(0, len(pair), RUN * HALF):
                        one = np.arange(a, min(len(pair), a + RUN * HALF))
                        two, _ = ragged(one, end[one] - one)
                        one = np.repeat(one, end[one] - one)
                        held[k].append(added(feature[one] * sizes[k] + feature[two], times[one] * times[two]))
                if sum(len(x) for found in held for x, _ in found) > MOST_PAIRS:
                    held[:] = [[added(*(np.concatenate(x) for x in zip(*found, strict=True)))] if found else [] for found in held]
                    if sum(len(x) for found in held for x, _ in found) > MOST_PAIRS // 2:
                        yield from given()
        yield from given()

    return run


def times_columns(shared):
    """Task over rows (r, at, n) of a symmetric matrix N: the rows (r, y) of W N W X, W the diagonal of the weights."""

    def run(batches):
        weight, x = shared.value
        x = x * weight[:, None]
        for batch in batches:
            for a in range(0, batch.num_rows, RUN):
                own = batch.slice(a, RUN)
                r, lists, n = own.column(0).to_numpy(), own.column(1), own.column(2).flatten().to_numpy()
                dense = np.zeros((len(r), len(x)))
                dense[np.repeat(np.arange(len(r)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = n
                y = (dense @ x) * weight[r][:, None]
                yield pa.RecordBatch.from_arrays([own.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))], names=["r", "y"])

    return run


def randomised_svd(rows: DataFrame, share: float, own: np.ndarray, weight: np.ndarray, latent: int) -> np.ndarray:
    """Right singular vectors (features by latent) of the halves whose pairs rows (r, at, n) has, each of that share, and of the rows own; products are made in Spark."""
    spark, n = rows.sparkSession, len(weight)
    rank = min(n, latent + EXTRA)

    def product(x: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast((weight, x))
        found = rows.mapInArrow(times_columns(shared), "r int, y array<double>").toArrow()  # as many numbers as features times rank
        out = own.T @ (own @ x)
        out[found["r"].to_numpy()] += share * found["y"].combine_chunks().flatten().to_numpy().reshape(-1, rank)
        shared.unpersist()
        return out

    x = np.random.default_rng(11).normal(size=(n, rank))
    for _ in range(ROUNDS):
        x = np.linalg.qr(product(np.linalg.qr(x)[0]))[0]
    values, vectors = np.linalg.eigh(x.T @ product(x))
    return x @ vectors[:, np.argsort(values)[::-1][: min(latent, rank)]]


@dataclass
class Index:
    """The latent space of a part of the benchmark."""

    items: Items
    keys: np.ndarray
    weight: np.ndarray
    #: latent vector of each feature, and of each passage over its full length
    latent: np.ndarray
    item_latent: np.ndarray
    #: the item of each passage
    owner: np.ndarray
    #: how many dimensions are of the SVD; the others complete the items
    svd: int


@dataclass
class Block:
    """Indexes searched at once, the features of all, and the position that each index has for them (-1: none)."""

    indexes: list[Index]
    keys: np.ndarray
    places: list[np.ndarray]


def completed(vectors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """vectors (orthonormal columns) and what directions more the rows need to keep KEPT of their squared norms."""
    rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    left = rows - rows @ vectors @ vectors.T
    left = left[(left**2).sum(1) > 1 - KEPT]
    if not len(left):
        return vectors
    _, size, more = np.linalg.svd(left, full_matrices=False)
    return np.concatenate([vectors, more[size > 1e-6].T], axis=1)


def features_of(items: Items, keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of items that tell them apart best, and their weights, of all their words with weights."""
    chosen = np.zeros(len(keys), bool)
    known = Lookup(keys)
    for words in items.passage_words():
        own = np.unique(known.find(words))
        chosen[own[np.argsort(-weight[own], kind="stable")[: max(LEAST_FEATURES, len(own) // 2)]]] = True
    return keys[chosen], weight[chosen]


def fit_part(rows: DataFrame, share: float, items: Items, keys: np.ndarray, weight: np.ndarray, latent: int) -> Index:
    """The latent space of items, from the weights of their features and all halves' pairs of them, each half of that share."""
    known = Lookup(keys)
    item_at = [at[at >= 0] for at in (known.find(w) for w in items.passage_words())]
    own = np.stack([np.bincount(at, weight[at], len(keys)) for at in item_at])
    vectors = randomised_svd(rows, share, ITEM_WEIGHT * own, weight, latent)
    svd = vectors.shape[1]
    vectors = completed(vectors, own)
    by_word = (vectors * weight[:, None]).astype(np.float32)
    item_latent = np.stack([by_word[at].sum(0) / np.sqrt(max((weight[at] ** 2).sum(), 1e-12)) for at in item_at]).astype(np.float32)
    return Index(items, keys, weight.astype(np.float32), by_word, item_latent, np.array([k for k, _, _ in items.passages]), svd)


def pair_rows(docs: DataFrame, keys: np.ndarray, places: list[np.ndarray], sizes: list[int]) -> DataFrame:
    """(part, r, at, n): for each feature of each part the features that share halves of docs (text) with it, itself included."""
    pairs = docs.select("text").mapInArrow(feature_pairs(keys, places, sizes), "part int, r int, c int, n long").groupBy("part", "r", "c").agg(F.sum("n").alias("n"))
    both = pairs.select("part", "n", F.explode(F.when(F.col("r") == F.col("c"), F.array(F.struct("r", "c"))).otherwise(F.array(F.struct("r", "c"), F.struct(F.col("c").alias("r"), F.col("r").alias("c"))))).alias("x"))
    held = both.groupBy("part", "x.r").agg(F.collect_list(F.struct("x.c", "n")).alias("x"))  # at most a part's features
    return held.select("part", "r", F.col("x.c").alias("at"), F.col("x.n").alias("n"))


def fit(docs: DataFrame, benchmark: DataFrame, latent: int = LATENT) -> list[Block]:
    """Indexes of all of the benchmark (item_id, text) in blocks, its words weighted and its latent spaces made by all rows of docs (text)."""
    own = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    n_words = F.size(F.split("text", r"\s+"))
    passages = own.agg(F.sum(F.when(n_words <= 2 * HALF, 1).otherwise(F.ceil(n_words / PASSAGE)))).first()[0] or 0
    parts = -(-passages // PART)
    found = []
    for begin in range(0, parts, BLOCK // PART):
        numbers = range(begin, min(parts, begin + max(1, BLOCK // PART)))
        number = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
        rows = own.withColumn("part", number).where(F.col("part").between(numbers[0], numbers[-1])).orderBy("item_id", "text").collect()  # items of about BLOCK passages
        own_items = [x for k in numbers if (x := read_items([r for r in rows if r["part"] == k])).ids]
        if not own_items:
            continue
        keys = np.unique(np.array([w for items in own_items for words in items.words for w in words], np.uint64))
        counts = docs.select("text").mapInArrow(count_halves(keys), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row for each key
        n = np.zeros(len(keys) + 1)
        n[counts["at"].to_numpy()] = counts["n"].to_numpy()  # at -1 is the last
        weight = np.maximum(0.1, np.log((n[-1] + 1) / (n[:-1] + 1)))
        features = []
        for items in own_items:
            mine = np.isin(keys, np.array([w for words in items.words for w in words], np.uint64))
            features.append(features_of(items, keys[mine], weight[mine]))
        keys = np.unique(np.concatenate([x for x, _ in features]))
        places = [Lookup(x).find(keys) for x, _ in features]
        pairs = saved(pair_rows(docs, keys, places, [len(x) for x, _ in features]), "feature-pairs")
        share = min(1.0, CORPUS / max(1.0, n[-1]))
        indexes = [fit_part(pairs.where(F.col("part") == k).drop("part"), share, items, *x, latent) for k, (items, x) in enumerate(zip(own_items, features, strict=True))]
        forget(pairs)
        found.append(Block(indexes, keys, places))
    return found


def parts_of(data: np.ndarray, offsets: np.ndarray, overlap: int, most: int = CHUNK_BYTES):
    """(number of the first text, words) of runs of whole texts of about ``most`` bytes; a text over twice that goes in parts.

    Each part begins with a half and shares ``overlap`` words, a multiple of HALF, with the part before."""
    for i, _, run, at in pieces(data, offsets, most):
        if len(run) <= 2 * most:
            yield i, words_of(run, at)
            continue
        begin, size = 0, most
        while begin < len(run):
            end = begin + size
            while end < len(run) and not _cut[run[end]]:
                end += 1
            end = min(end, len(run))
            words = words_of(run[begin:end], np.array([0, end - begin]))
            whole = len(words) // HALF * HALF
            if end < len(run) and whole <= overlap:  # too few words to go on from
                size *= 2
                continue
            if end < len(run):
                last = int(words.end[whole - 1])
                words = words_of(run[begin : begin + last], np.array([0, last]))
            yield i, words
            if end == len(run):
                break
            begin, size = begin + (int(words.start[whole - overlap]) if overlap else last), most


def matches(block: Block, known: Lookup, texts: pa.Array) -> list[tuple[int, int, float, float, float]]:
    """(text number, item id, cosine, share of the item's words in order, share of its answer's) of all matches; known has the block's keys."""
    best: dict[tuple[int, int, int], tuple[float, float, float]] = {}
    longest = max((len(w) for index in block.indexes for w in index.items.words), default=0)
    overlap = HALF * (4 + 2 * (longest // HALF + 1))  # a window of any item, and the rest of the item on both sides
    for i, words in parts_of(*utf8(lowered(texts)), overlap):
        if not len(words):
            continue
        h = words.hashes()
        half, begin = halves_of(words.first)
        at = known.find(h)
        for n, (index, place) in enumerate(zip(block.indexes, block.places, strict=True)):
            for t, k, near, share, answer in matches_of(index, words, h, np.where(at >= 0, place[at], -1), half, begin):
                best[i + t, n, k] = max(best.get((i + t, n, k), (0.0, 0.0, 0.0)), (share, answer, near))
    return [(t, block.indexes[n].items.ids[k], near, share, answer) for (t, n, k), (share, answer, near) in best.items()]


def matches_of(index: Index, words: Words, h: np.ndarray, at: np.ndarray, half: np.ndarray, begin: np.ndarray) -> list[tuple[int, int, float, float, float]]:
    """(text number, item number, cosine, shares) of the matches of an index, of words with hashes h that are its features at."""
    hit = np.flatnonzero(at >= 0)
    if not len(hit):
        return []
    first = np.flatnonzero(np.concatenate([[True], np.diff(half[hit]) != 0]))
    own = half[hit][first]
    vectors, norm = np.zeros((begin[-1] + 1, index.latent.shape[1]), np.float32), np.zeros(begin[-1] + 1, np.float32)
    for a in range(0, len(first), RUN):  # a run of halves at a time: a row of the latent space for each hit is large
        low, high = first[a], first[a + RUN] if a + RUN < len(first) else len(hit)
        vectors[own[a : a + RUN]] = np.add.reduceat(index.latent[at[hit[low:high]]], first[a : a + RUN] - low)
    pair, times = np.unique(half[hit] * np.int64(len(index.keys)) + at[hit], return_counts=True)
    norm += np.bincount(pair // len(index.keys), (times * index.weight[pair % len(index.keys)]) ** 2, len(norm)).astype(np.float32)
    follows = np.ones(begin[-1], np.float32)
    follows[begin[1:][begin[1:] > begin[:-1]] - 1] = 0  # the last half of a text
    # halves count as orthogonal in what the latent space leaves out
    norm = norm[:-1] + norm[1:] * follows
    inner, cosine = np.float32(0), np.full((len(follows), len(index.owner)), -1, np.float32)
    for part in (slice(index.svd), slice(index.svd, None)):  # the SVD's cosine, then that with what completes the items: the greater counts
        x = vectors[:, part]
        norm = norm + 2 * (x[:-1] * x[1:]).sum(1) * follows
        inner = inner + (x[:-1] + x[1:] * follows[:, None]) @ index.item_latent[:, part].T
        np.maximum(cosine, inner / np.sqrt(np.maximum(norm, 1e-6))[:, None], out=cosine)
    window, passage = np.nonzero(cosine >= COSINE)
    if not len(window):
        return []
    top, item = cosine[window, passage], index.owner[passage]
    text = np.searchsorted(begin, window, "right") - 1
    order = np.lexsort((window, item, text))
    window, item, text, top = window[order], item[order], text[order], top[order]
    size = np.array([len(w) for w in index.items.words])[item]
    reach = np.where(size > 2 * HALF, size // HALF + 1, 1)  # halves before and after a candidate in which the rest of the item may be
    new = np.concatenate([[True], (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(window) > 1 + reach[1:])])
    ends = np.append(np.flatnonzero(new)[1:], len(window))
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for a, b in zip(np.flatnonzero(new).tolist(), ends.tolist(), strict=True):
        t, k, r = int(text[a]), int(item[a]), int(reach[a])
        low = max(int(words.first[t]), int(words.first[t]) + HALF * (int(window[a]) - int(begin[t]) - r))
        high = min(int(words.first[t + 1]), int(words.first[t]) + HALF * (int(window[b - 1]) - int(begin[t]) + 2 + r))
        n, m = len(index.items.words[k]), len(index.items.answers[k])
        least = SHARE if n >= SHORT else 1
        near, kinds = h[low:high], index.items.kinds[k]
        known = kinds[np.minimum(np.searchsorted(kinds, near), len(kinds) - 1)] == near
        so_far = np.concatenate([[0], np.cumsum(known)])
        for at_word in range(0, max(1, len(near) - n), max(1, n // 2)):  # spans that hold any run of n words whole
            stop = min(len(near), at_word + n + n // 2 + 1)
            if so_far[stop] - so_far[at_word] < least * n:
                continue
            span = near[at_word:stop][known[at_word:stop]].tolist()
            share = lcs(index.items.word_masks[k], n, span) / n
            if share >= least and (answer := lcs(index.items.answer_masks[k], m, span) / m) >= ANSWER_SHARE:
                best[t, k] = max(best.get((t, k), (0, 0, 0)), (share, answer, float(min(1, top[a:b].max()))))
    return [(t, k, near, share, answer) for (t, k), (share, answer, near) in best.items()]


def find(docs: DataFrame, blocks: list[Block]) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share) of all documents of docs (doc_id, text) that hold an item."""
    spark = docs.sparkSession
    out = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            own = shared.value
            known = Lookup(own.keys)
            for batch in batches:
                found = matches(own, known, batch.column(1))
                row, item, *rest = zip(*found, strict=True) if found else [()] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(item, pa.int64()), *(pa.array(x, pa.float64()) for x in rest)], names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

        found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, item_id long, cosine double, lcs_share double, answer_share double")
        out = found if out is None else out.unionAll(found)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, cosine double, lcs_share double, answer_share double")


def holder(spark: SparkSession, block: Block):
    """A column function: text -> whether it holds an item of the block."""
    shared = spark.sparkContext.broadcast(block)

    kept: list[Lookup] = []

    @F.arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        if not kept:  # once for each task
            kept.append(Lookup(shared.value.keys))
        out = np.zeros(len(texts), bool)
        out[[m[0] for m in matches(shared.value, kept[0], texts)]] = True
        return pa.array(out)

    return holds


def keep_unmatched(docs: DataFrame, blocks: list[Block]) -> DataFrame:
    """Rows of docs that hold no item; columns stay as they are."""
    for block in blocks:
        docs = docs.where(~holder(docs.sparkSession, block)(F.col("text").cast("string")))
    return docs


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs, table(spark, sf_dir, "benchmark")))
