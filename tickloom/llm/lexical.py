"""Ranked lexical search with hashed max-sketches.

The index has a sketch for each document: its terms are hashed to ``COORDINATES`` coordinates, and a
coordinate holds the greatest term frequency of its terms. Impacts of a document rise with the
frequency, so an impact of a coordinate's maximum is at least that of any of its terms, and the sum over
an item's terms, weight times impact, bounds the item's score from above. Only occupied coordinates are
kept. Items are looked up in blocks of about ``BLOCK``: one pass over the sketches adds up the
bounds of all documents for all items of a block.

Each item's K documents of the highest bounds are scored exactly first, on their texts. The K-th best of those scores is
the threshold: a document whose bound is below it can't be among the K best, and all others are scored
exactly. So results are exact whatever collides in the sketches; collisions only cost more scoring.

Scores are whole numbers. Term weights need document frequencies of the items' terms alone, counted in
one pass over the texts for each block. Texts over ``PART`` bytes are counted in parts.

Defined results: null texts have no terms and never rank; an item without terms has no rows; a
repeated benchmark row has a list of its own; documents with equal ids are ranked each, null ids last
among equal scores; among equal scores and ids any order; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import CHUNK_BYTES, LOWER, Lookup, Words, forget, pieces, ragged, saved, table, utf8

#: Coordinates of a sketch, and the frequency that stands for itself and all above.
COORDINATES, MOST_TF = 1 << 16, (1 << 16) - 1
#: Documents of a list, items (about) and bytes of items looked up at once, candidates that are broadcast, bytes of a part of a long text.
K, BLOCK, BLOCK_BYTES, MOST_BROADCAST, PART = 50, 1024, 8 << 20, 1 << 20, 4 << 20

#: Terms are runs of ASCII letters and digits and of all bytes of characters beyond ASCII.
_cut = np.ones(256, bool)
_cut[[b for b in range(256) if b >= 0x80 or chr(b).isalnum()]] = False


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, frequency) of the distinct terms of each text, by text and hash, and each text's number of terms."""
    n = len(offsets) - 1
    if n == 1 and len(data) > 2 * PART:
        return _long_terms(data)
    words = Words(data, offsets, LOWER, _cut)
    size = np.diff(words.first)
    text, h = np.repeat(np.arange(n), size), words.hashes()
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
    return text[first], h[first], np.diff(np.append(first, len(h))), size


def _long_terms(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """terms_of one text, in parts that end between terms."""
    h, tf, total, begin = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0
    while begin < len(data):
        end = min(len(data), begin + PART)
        while end < len(data) and not _cut[data[end]]:
            end += 1
        words = Words(data[begin:end], np.array([0, end - begin]), LOWER, _cut)
        total += len(words)
        own, times = np.unique(words.hashes(), return_counts=True)
        h, at = np.unique(np.concatenate([h, own]), return_inverse=True)
        tf = np.bincount(at, np.concatenate([tf, times]), len(h)).astype(np.int64)
        begin = end
    return np.zeros(len(h), np.int64), h, tf, np.array([total])


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How much a term that occurs tf times counts in a document of length factor m; rises with tf, to at most a million."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


@dataclass
class Index:
    """Sketches of documents: (doc_id, text_hash, terms, at, most), how many have terms, and how many terms all have."""

    sketches: DataFrame
    documents: int
    terms: int

    def m(self, terms: np.ndarray) -> np.ndarray:
        """The length factor of documents of so many terms."""
        return 50 + 50 * terms * self.documents // self.terms


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over (doc_id, text_hash, text)."""
    for batch in batches:
        for i, j, data, offsets in pieces(*utf8(batch.column(2))):
            text, h, tf, size = terms_of(data, offsets)
            place = text * COORDINATES + (h >> np.uint64(48)).astype(np.int64)  # rises, as hashes do within a text
            first = np.flatnonzero(np.concatenate([[True], np.diff(place) != 0])) if len(place) else np.zeros(0, np.int64)
            most = np.minimum(np.maximum.reduceat(tf, first), MOST_TF) if len(first) else tf
            begin = np.searchsorted(place[first], np.arange(j - i + 1) * COORDINATES)
            raw = lambda x: pa.array([x[a:b].astype("<u2").tobytes() for a, b in zip(begin[:-1], begin[1:])], pa.binary())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(size.astype(np.int64)), raw(place[first] % COORDINATES), raw(most)], names=["doc_id", "text_hash", "terms", "at", "most"])


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))


def index(docs: DataFrame) -> Index:
    """The index of docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketches = saved(keyed(docs).mapInArrow(_sketch, f"doc_id {kind}, text_hash long, terms long, at binary, most binary"), "max-sketches")
    total = sketches.where("terms > 0").agg(F.count("*").alias("n"), F.sum("terms").alias("terms")).first()
    return Index(sketches, total["n"], total["terms"] or 0)


@dataclass
class Block:
    """Some items: their distinct terms' hashes, the terms of each (items of term k from first[k]), and the terms' weights."""

    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    #: the same by coordinate: of each item the weights of all its terms there
    coordinate: np.ndarray
    c_first: np.ndarray
    c_item: np.ndarray
    c_weight: np.ndarray
    items: int


def df_of(docs: DataFrame, keys: np.ndarray) -> np.ndarray:
    """How many documents have each of the terms with these hashes."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches):
        known = Lookup(shared.value)
        counts = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for _, _, data, offsets in pieces(*utf8(batch.column(0))):
                at = known.find(terms_of(data, offsets)[1])
                counts += np.bincount(at[at >= 0], minlength=len(counts))
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(counts[there])], names=["at", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the block
    out = np.zeros(len(keys), np.int64)
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)


def block_of(found: Index, docs: DataFrame, texts: list[str | None]) -> Block:
    item, h, _, _ = terms_of(*utf8(pa.array(texts, pa.large_string())))
    keys, at = np.unique(h, return_inverse=True)
    weight = weights(found.documents, df_of(docs, keys))
    order = np.argsort(at, kind="stable")
    place = (keys >> np.uint64(48)).astype(np.int64)[at] * len(texts) + item
    both, inverse = np.unique(place, return_inverse=True)
    coordinate, c_first = np.unique(both // max(1, len(texts)), return_index=True)
    return Block(keys, np.append(np.searchsorted(at[order], np.arange(len(keys))), len(at)), item[order], weight, coordinate, np.append(c_first, len(both)), both % max(1, len(texts)), np.bincount(inverse, weight[at], len(both)), len(texts))


def added(doc: np.ndarray, value: np.ndarray, at: np.ndarray, first: np.ndarray, item: np.ndarray, weight: np.ndarray, docs: int, items: int) -> np.ndarray:
    """Sums of weight x value by document and item; entry e counts for the items of at[e]. Whole numbers below 2 ** 53, as doubles."""
    take, begin = ragged(first[at], first[at + 1] - first[at])
    times = np.diff(begin)
    return np.bincount(np.repeat(doc, times) * items + item[take], np.repeat(value, times) * weight[take], docs * items).reshape(docs, items)


#: Documents whose sums are made at once.
ROWS = 256


def bounds(found: Index, block: Block, terms: np.ndarray, at: list[bytes], most: list[bytes]) -> np.ndarray:
    """Upper bounds of the scores of all items for documents with these sketches."""
    place = np.full(COORDINATES, -1)
    place[block.coordinate] = np.arange(len(block.coordinate))
    size = np.array([len(x) // 2 for x in at], np.int64)
    doc, own, tf = np.repeat(np.arange(len(at)), size), place[np.frombuffer(b"".join(at), "<u2")], np.frombuffer(b"".join(most), "<u2").astype(np.int64)
    doc, own, tf = doc[own >= 0], own[own >= 0], tf[own >= 0]
    tf = np.where(tf == MOST_TF, 1 << 30, tf)
    return added(doc, impact(tf, found.m(terms)[doc]), own, block.c_first, block.c_item, block.c_weight, len(at), block.items)


def scores(found: Index, block: Block, known: Lookup, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Exact scores of all items for texts; known has the block's keys."""
    doc, h, tf, size = terms_of(data, offsets)
    own = known.find(h)
    doc, own, tf = doc[own >= 0], own[own >= 0], tf[own >= 0]
    weight = block.weight[np.repeat(np.arange(len(block.keys)), np.diff(block.first))]
    return added(doc, impact(tf, found.m(size)[doc]), own, block.first, block.item, weight, len(size), block.items)


class Best:
    """The rows of the k highest values for each item that a task has seen, of equal values those of the smallest ids."""

    def __init__(self, items: int, k: int):
        self.items, self.k = items, k
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.least, self.rows = np.zeros(items), 0

    def add(self, item: np.ndarray, value: np.ndarray, doc_id: np.ndarray, text_hash: np.ndarray) -> None:
        own = value >= self.least[item]
        if own.any():
            self.parts.append(tuple(x[own] for x in (item, value, doc_id, text_hash)))
            self.rows += np.count_nonzero(own)
        if self.rows > 4 * self.k * self.items + 100_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
        item, value, doc_id, text_hash = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((doc_id, -value, item))
        item, value, doc_id, text_hash = item[order], value[order], doc_id[order], text_hash[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kept = place < self.k
        last = place == self.k - 1
        self.least[item[last]] = value[last]
        self.parts = [(item[kept], value[kept], doc_id[kept], text_hash[kept])]
        self.rows = np.count_nonzero(kept)
        return self.parts[0]


NO_ID = np.iinfo(np.int64).max
FOUND = "item int, value double, doc_id long, text_hash long"


def _found(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    item, value, doc_id, text_hash = rows
    return pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(value), pa.array(doc_id, mask=doc_id == NO_ID), pa.array(text_hash)], names=["item", "value", "doc_id", "text_hash"])


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def best_bounds(found: Index, block: Block, k: int, least: np.ndarray | None = None) -> DataFrame:
    """(item, value, doc_id, text_hash): without least the k highest bounds above 0 of each task and item, else all bounds of at least that item's."""
    shared = found.sketches.sparkSession.sparkContext.broadcast((block, least))
    bare = Index(None, found.documents, found.terms)

    def run(batches):
        own, lowest = shared.value
        best = Best(own.items, k)
        for batch in batches:
            terms, doc_id, text_hash = batch.column(2).to_numpy(), _ids(batch.column(0)), batch.column(1).to_numpy()
            for a in range(0, batch.num_rows, ROWS):
                at, most = (batch.column(c)[a : a + ROWS].to_pylist() for c in (3, 4))
                upper = bounds(bare, own, terms[a : a + ROWS], at, most)
                doc, item = np.nonzero(upper > 0 if lowest is None else upper >= lowest)
                rows = item, upper[doc, item], doc_id[a + doc], text_hash[a + doc]
                if lowest is None:
                    best.add(*rows)
                else:
                    yield _found(rows)
        if lowest is None:
            yield _found(best.cut())

    return found.sketches.where("terms > 0").mapInArrow(run, FOUND)


def best_scores(found: Index, block: Block, docs: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(item, value, doc_id, text_hash): exact scores above 0 of the candidates' texts, the k best of each task and item."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    bare = Index(None, found.documents, found.terms)
    keys = candidates.select(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash")).distinct()
    keys = F.broadcast(keys) if keys.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else keys
    own = keyed(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    own = own.join(keys, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_hash") == F.col("c_hash")), "left_semi")

    def run(batches):
        block = shared.value
        known, best = Lookup(block.keys), Best(block.items, k)
        for batch in batches:
            doc_id, text_hash = _ids(batch.column(0)), batch.column(1).to_numpy()
            for i, _, data, offsets in pieces(*utf8(batch.column(2)), CHUNK_BYTES):
                exact = scores(bare, block, known, data, offsets)
                doc, item = np.nonzero(exact > 0)
                best.add(item, exact[doc, item], doc_id[i + doc], text_hash[i + doc])
        yield _found(best.cut())

    return own.mapInArrow(run, FOUND)


def top(rows: DataFrame, k: int) -> DataFrame:
    """The k highest values of each item with their rank, equal values by rising id."""
    w = Window.partitionBy("item").orderBy(F.desc("value"), F.asc_nulls_last("doc_id"), "text_hash")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_block(found: Index, docs: DataFrame, texts: list[str | None], k: int) -> DataFrame:
    """(item, rank, doc_id, score) of a block's items, by number."""
    block = block_of(found, docs, texts)
    first = saved(top(best_bounds(found, block, k), k), "first-candidates")
    scored = top(best_scores(found, block, docs, first, k), k)
    least = np.ones(block.items)  # a score above 0 is at least 1
    for r in scored.where(F.col("rank") == k).select("item", "value").collect():  # a row for each item
        least[r["item"]] = max(1.0, r["value"])
    rest = saved(best_bounds(found, block, k, least).select("doc_id", "text_hash").distinct(), "candidates")
    exact = saved(top(best_scores(found, block, docs, rest, k), k), "ranked")
    forget(first, rest)
    return exact.select("item", "rank", "doc_id", F.col("value").cast("long").alias("score"))


def search(found: Index, docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of docs, those of the index, for each of queries (item_id, text)."""
    spark, kind = docs.sparkSession, queries.schema["item_id"].dataType.simpleString()
    own = queries.select("item_id", F.col("text").cast("string").alias("text"))
    size = own.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(-(-size["n"] // BLOCK), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    out = None
    for part in range(parts if found.documents else 0):
        rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()  # a block of items
        if not rows:
            continue
        names = F.broadcast(spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {kind}"))
        ranked = search_block(found, docs, [r["text"] for r in rows], k).join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = ranked if out is None else out.unionAll(ranked)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = index(docs)
    ranked = search(found, docs, table(spark, sf_dir, "benchmark"))
    forget(found.sketches)
    return ranked.select(F.col("item_id").cast("long").alias("item_id"), "rank", "doc_id", "score")


SQL = r"""
with words as (
  select doc_id, rowid_ as d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select *, row_number() over () as rowid_ from documents)
), tf as (
  select d, any_value(doc_id) as doc_id, term, count(*) as tf from words group by d, term
), lengths as (
  select d, sum(tf)::bigint as n from tf group by d
), total as (
  select count(*)::bigint as docs, sum(n)::bigint as terms from lengths
), asked as (
  select distinct i, item_id, term from (
    select i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from (select *, row_number() over () as i from benchmark)
  )
), weights as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w
  from (select term, count(*)::bigint as df from tf where term in (select term from asked) group by term), total
), scores as (
  select a.i, a.item_id, t.doc_id, t.d, sum(w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * (50 + (50 * l.n * docs) // terms))))::bigint as score
  from asked a join tf t using (term) join weights using (term) join lengths l on l.d = t.d, total
  group by a.i, a.item_id, t.doc_id, t.d
), ranked as (
  select *, row_number() over (partition by i order by score desc, doc_id nulls last) as rank from scores where score > 0
)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 50
"""
