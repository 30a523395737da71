"""Document fingerprints by locally consistent parsing.

Runs of equal symbols are joined; deterministic coin tossing then labels every symbol from itself
and its left neighbour, again and again, until six labels are left; symbols whose label is a local
maximum begin phrases, and a phrase's name is a hash of its symbols. The names are the symbols of
the next level. Where a phrase begins depends on a few neighbours only, so equal substrings get the
same interior names at any offset. A fingerprint keeps, in each of ``BINS`` bins of the names of
levels ``LEVELS``, a 16-bit mark of the smallest name; likeness is the share of equal bins among
those that either has filled, an estimate of the Jaccard similarity of the names.

Neighbours by id: rows are dealt to ranges of the id that end at ids of the table; the row that
begins a range is copied to the range before it, so each task finds every next document.

Defined results: null texts are empty; an empty text has a fingerprint of empty bins, and two of
those have likeness 1. Equal ids are ordered by text. A row with a null id has no next document: it
counts as empty. A single document is its own next one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import BASE, id_bounds, mix, pieces, table, utf8

BINS, LEVELS = 64, (2, 3, 4)
#: Coin-tossing rounds that leave six labels of 8-bit and 64-bit symbols.
ROUNDS = {1: 3, 8: 4}
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _toss(symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Labels: twice the lowest bit in which a symbol differs from its left neighbour (at a beginning: from 0), plus that bit."""
    differ = symbols.copy()
    differ[1:] ^= symbols[:-1]
    differ[begins] = symbols[begins]
    low = differ & (~differ + symbols.dtype.type(1))
    place = np.bitwise_count(low - symbols.dtype.type(1)).astype(np.uint8)
    return 2 * (place & 63) + ((symbols & low) != 0)


def next_level(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the phrases of each run of symbols, and where each run's begin."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.uint64), first
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    begins = begins[:n]
    new = np.ones(n, bool)
    new[1:] = symbols[1:] != symbols[:-1]
    new |= begins
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, n))
    one, begins = symbols[at], begins[at]
    labels = one
    for _ in range(ROUNDS[symbols.dtype.itemsize]):
        labels = _toss(labels, begins)
    top = begins.copy()
    top[1:-1] |= (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:]) & ~begins[2:]  # the last of a run begins nothing
    start = np.flatnonzero(top)
    named = one.astype(np.uint64)
    many = length > 1
    named[many] = mix(named[many] * np.uint64(BASE) + length[many].astype(np.uint64))
    end = np.append(start[1:], len(named))
    names = mix((end - start).astype(np.uint64) + np.uint64(BASE))
    todo, place = np.arange(len(start)), start.copy()
    while len(todo):  # a phrase has a dozen symbols at most
        names[todo] = mix((names[todo] ^ named[place]) * np.uint64(BASE))
        more = place + 1 < end[todo]
        todo, place = todo[more], place[more] + 1
    return names, np.searchsorted(at[start], first)


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of BINS 16-bit marks for each text; 0 is an empty bin."""
    n = len(offsets) - 1
    least = np.full(n * BINS, np.iinfo(np.uint64).max, np.uint64)
    for i, j, own, first in pieces(data, offsets):
        symbols = own
        for level in range(1, max(LEVELS) + 1):
            symbols, first = next_level(symbols, first)
            if level in LEVELS:
                owner = np.repeat(np.arange(i, j), np.diff(first))
                h = mix(symbols + np.uint64(level))
                np.minimum.at(least, owner * BINS + (h & np.uint64(BINS - 1)).astype(np.int64), h)
    marks = (mix(least) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
    marks[least == np.iinfo(np.uint64).max] = 0
    return marks.reshape(n, BINS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, from 0 to 1."""
    filled = ((a > 0) | (b > 0)).sum(1)
    return np.where(filled > 0, ((a == b) & (a > 0)).sum(1) / np.maximum(filled, 1), 1.0)


def _marks(texts: list[str]) -> np.ndarray:
    return fingerprints(*utf8(pa.array(texts, pa.large_string())))


def _hex(marks: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes().hex() for row in marks.astype(">u2")], pa.string())


def fingerprint_udf():
    """A column function: text -> fingerprint as lowercase hex."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return _hex(fingerprints(*utf8(texts)))

    return run


def edited(text: str, following: str) -> str:
    """text with its last third (rounded down) replaced by as many first characters of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _compare(ids, texts: list[str], following: list[str], marks: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
    """Rows of SCHEMA; marks and after are the fingerprints of the texts and of the following ones."""
    new = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    changed = _marks(new)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
            _hex(marks), _hex(changed), pa.array(likeness(marks, changed)), pa.array(likeness(marks, after)),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _compare_sorted(batches):
    """Task over (doc_id, text, bucket, helper), sorted: each row that is no helper with the row after it in its bucket."""
    held: tuple | None = None
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            ids, texts, buckets, helper = (part.column(k).to_pylist() for k in range(4))
            texts = [t or "" for t in texts]
            marks = _marks(texts)
            if held:
                ids, texts, buckets, helper = ([x, *y] for x, y in zip(held[:4], (ids, texts, buckets, helper), strict=True))
                marks = np.concatenate([held[4], marks])
            held = ids[-1], texts[-1], buckets[-1], helper[-1], marks[-1:]
            pairs = [k for k in range(len(ids) - 1) if not helper[k] and buckets[k] == buckets[k + 1]]
            if pairs:
                k = np.array(pairs)
                yield _compare([ids[k] for k in pairs], [texts[k] for k in pairs], [texts[k + 1] for k in pairs], marks[k], marks[k + 1])


def _compare_alone(batches):
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        yield _compare(batch.column(0), texts, [""] * len(texts), _marks(texts), _marks([""] * len(texts)))


def bucket_udf(bounds: np.ndarray):
    """id -> its bucket (the first bound not below it); a bound's id also as -1 - the bucket that it helps."""

    @F.arrow_udf("array<int>")
    def run(ids: pa.Array) -> pa.Array:
        own = ids.to_numpy(zero_copy_only=False).astype(np.int64)
        bucket = np.minimum(np.searchsorted(bounds, own), len(bounds) - 1)
        helps = bounds[bucket] == own
        sizes = np.concatenate([[0], np.cumsum(1 + helps)])
        values = np.repeat(bucket, 1 + helps)
        values[sizes[:-1][helps] + 1] = -1 - (bucket[helps] + 1) % len(bounds)
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values, pa.int32()))

    return run


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text): fingerprints of its text and its edited text, and their likeness; columns as in SCHEMA."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    alone = docs.where("doc_id is null").mapInArrow(_compare_alone, SCHEMA)
    bounds = id_bounds(docs)
    if not len(bounds):
        return alone
    dealt = docs.where("doc_id is not null").withColumn("to", F.explode(bucket_udf(bounds)("doc_id")))
    helper = F.col("to") < 0
    dealt = dealt.select("doc_id", "text", F.when(helper, -1 - F.col("to")).otherwise(F.col("to")).alias("bucket"), helper.alias("helper"))
    ordered = dealt.repartitionById(len(bounds), "bucket").sortWithinPartitions("bucket", "helper", F.desc("doc_id"), "text")
    return ordered.mapInArrow(_compare_sorted, SCHEMA).unionByName(alone)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
