"""Shared pieces: shared-folder tables, and text as numpy arrays inside Arrow tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy works on at a time; a longer text is one piece of its own.
CHUNK_BYTES = 1 << 20
#: An odd multiplier that chains hashes, and the hash that stands for the end of a text.
BASE = 0x9E3779B97F4A7C15
END_HASH = np.uint64(0x0E0E0E0E0E0E0E0E)
#: Spans of up to this many bytes are hashed in numpy, 8 bytes at a time; longer ones by XXH64.
LANES_END = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else what the context has; a new one only where driver and tasks are one process."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        context.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


_saved: dict[int, tuple[DataFrame, str]] = {}


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows written to the shared folder and read again: later steps start from files, not from their lineage."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    _saved[id(found)] = found, path
    return found


def forget(*tables: DataFrame | None) -> None:
    """Delete saved tables that nothing reads any more; others are left alone."""
    for df in tables:
        held, path = _saved.pop(id(df), (None, ""))
        if held is not None:
            jvm = held.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(held.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


#: Bytes of text in a range of ids, about, and most ranges.
RANGE_BYTES, MOST_RANGES = 64 << 20, 50_000


def _percentiles(docs: DataFrame) -> tuple[list[int], int | None, int]:
    """(ids that cut docs (doc_id, text) into parts of about RANGE_BYTES, an id as often as it holds a part; last id; bytes of texts without an id)."""
    none = F.sum(F.when(F.col("doc_id").isNull(), F.octet_length("text")))
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), none.alias("none"), F.max("doc_id").alias("last")).first()
    if size["last"] is None:
        return [], None, size["none"] or 0
    n = int(min(MOST_RANGES, max(2, -(-((size["bytes"] or 0) - (size["none"] or 0)) // RANGE_BYTES))))
    at = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 20 * n)).alias("at")).first()["at"]
    return at, size["last"], size["none"] or 0


def id_bounds(docs: DataFrame) -> np.ndarray:
    """Rising last ids of ranges of docs (doc_id, text) that hold about RANGE_BYTES each; empty without ids."""
    at, last, _ = _percentiles(docs)
    return np.unique(np.array([*at, last] if last is not None else [], np.int64))


class Shards:
    """Numbers of shards of docs (doc_id, text) in rising order of ids, nulls first, of about RANGE_BYTES each: ranges of ids, and shares by text of an id (or null) that holds more."""

    def __init__(self, docs: DataFrame):
        at, last, none = _percentiles(docs)
        self.none = max(1, -(-none // RANGE_BYTES))
        ends, parts = [], []
        found, times = np.unique(np.array([*at, last] if last is not None else [], np.int64), return_counts=True)
        for end, n in zip(found.tolist(), times.tolist(), strict=True):
            if n > 2 and (not ends or end - 1 > ends[-1]):  # the ids before it are a range of their own
                ends.append(end - 1)
                parts.append(1)
            ends.append(end)
            parts.append(n if n > 2 else 1)
        self.ends, self.parts = np.array(ends, np.int64), np.array(parts, np.int64)
        self.first = self.none + np.cumsum(self.parts) - self.parts
        self.n = int(self.none + self.parts.sum())

    def of(self, ids: pa.Array, texts: pa.Array) -> np.ndarray:
        """The shard of each document."""
        null = ids.is_null().to_numpy(zero_copy_only=False)
        cell = np.minimum(np.searchsorted(self.ends, ids.fill_null(0).to_numpy()), max(0, len(self.ends) - 1))
        parts, first = (np.where(null, alone, x[cell] if len(x) else alone) for x, alone in ((self.parts, self.none), (self.first, 0)))
        for k in np.flatnonzero(parts > 1).tolist():
            first[k] += xxhash.xxh64_intdigest((texts[k].as_py() or "").encode(), 5) % int(parts[k])
        return first.astype(np.int32)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one more offset at the end). Nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(column: pa.Array) -> pa.Array:
    """Lower case in all scripts."""
    return pc.utf8_lower(column)


def pieces(data: np.ndarray, offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``most`` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


_LANE_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes that begin at each place, as one value; bytes after the end count as zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from start to end."""
    size = end - start
    own = lanes(data)
    h = mix(size.astype(np.uint64) + np.uint64(BASE))
    todo = np.arange(len(start)) if size.max(initial=0) <= LANES_END else np.flatnonzero(size <= LANES_END)
    at, left = start[todo], size[todo]
    for _ in range(0, LANES_END, 8):
        more = left > 0
        if not more.all():
            todo, at, left = todo[more], at[more], left[more]
        if not len(todo):
            break
        h[todo] = mix((h[todo] ^ (own[at] & _LANE_MASK[np.minimum(left, 8)])) * np.uint64(BASE))
        at, left = at + 8, left - 8
    long = np.flatnonzero(size > LANES_END)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        h[long] = [xxhash.xxh64_intdigest(raw[a:b], 17) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return h


def same_spans(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of ``size`` bytes of a and b are the same bytes, one by one."""
    same = np.ones(len(size), bool)
    of_a, of_b = lanes(a), lanes(b)
    todo, left, x, y = np.arange(len(size)), size, a_start, b_start
    while len(todo):
        more = left > 0
        todo, left, x, y = todo[more], left[more], x[more], y[more]
        equal = (of_a[x] ^ of_b[y]) & _LANE_MASK[np.minimum(left, 8)] == 0
        same[todo[~equal]] = False
        todo, left, x, y = todo[equal], left[equal] - 8, x[equal] + 8, y[equal] + 8
    return same


class Words:
    """Words of a run of texts: lower-cased A-Z, cut at ``space`` bytes and at the ends of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: np.ndarray = LOWER, space: np.ndarray = SPACE):
        self.low = lower[data]
        blank = space[self.low]
        n = len(blank)
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = blank[:-1], blank[1:]
        before[offsets[:-1][offsets[:-1] < n]] = True
        after[offsets[1:][offsets[1:] > 0] - 1] = True
        word = ~blank
        self.start, self.end = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
        #: index of each text's first word, one more at the end
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes from start to end."""
        return span_hash(self.low, start, end)

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


def ragged(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, firsts): the positions of runs that start at begin, one run after the other, and where each run's begin."""
    first = np.concatenate([[0], np.cumsum(size)])
    return np.arange(first[-1]) + np.repeat(begin - first[:-1], size), first


class IdMemory:
    """The ids of the strings that a worker has encoded; it starts anew when it holds ``most``.

    Strings are found by their hashes and compared byte by byte; a string whose hash another one has is encoded anew each time."""

    def __init__(self, most: int):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.known, self.begin, self.ids, self.used = Lookup(np.zeros(0, np.uint64)), np.zeros(1, np.int64), np.zeros(1 << 16, np.int32), 0
        self.place, self.text, self.filled = np.zeros(1, np.int64), np.zeros(1 << 16, np.uint8), 0

    def _learn(self, keys: np.ndarray, found: list[list[int]], data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        flat = np.array([x for ids in found for x in ids], np.int32)
        take, _ = ragged(start, end - start)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.filled + len(take) + 8 > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.text[self.filled : self.filled + len(take)] = data[take]
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(ids) for ids in found])])
        self.place = np.concatenate([self.place, self.place[-1] + np.cumsum(end - start)])
        self.used += len(flat)
        self.filled += len(take)
        self.known.add(keys)

    def ids_of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the strings from start to end of data, and where each string's begin; encode gives the id lists of strings by their positions."""
        h = span_hash(data, start, end)
        at = self.known.find(h)
        if (at < 0).any():
            if len(self.known.keys) + np.count_nonzero(at < 0) > self.most:
                self.forget()
                at[:] = -1
            missing = np.flatnonzero(at < 0)
            keys, first = np.unique(h[missing], return_index=True)
            new = missing[first]
            self._learn(keys, encode(new), data, start[new], end[new])
            at = self.known.find(h)
        take, first = ragged(self.begin[at], self.begin[at + 1] - self.begin[at])
        ids = self.ids[take]
        size = end - start
        other = size != self.place[at + 1] - self.place[at]
        other[~other] = ~same_spans(self.text[: self.filled], self.place[at[~other]], data, start[~other], size[~other])
        if other.any():
            own = dict(zip(np.flatnonzero(other).tolist(), encode(np.flatnonzero(other)), strict=True))
            parts = [np.array(own[k], np.int32) if k in own else ids[first[k] : first[k + 1]] for k in range(len(h))]
            first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids = np.concatenate([np.zeros(0, np.int32), *parts])
        return ids, first


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs of values; run i goes from first[i] to first[i + 1] and may be empty."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.result_type(values.dtype, np.int64) if values.dtype.kind in "iub" else np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


class Lookup:
    """Positions of distinct 64-bit keys in a key list that may grow, by a table addressed with their low bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.zeros(0, np.uint64)
        self.mask = np.uint64(0)
        self.add(keys)

    def add(self, keys: np.ndarray) -> None:
        """Append keys that aren't in the list."""
        old, self.keys = len(self.keys), np.concatenate([self.keys, np.asarray(keys, np.uint64)])
        if not old or 2 * len(self.keys) > int(self.mask):
            self.mask = np.uint64((1 << max(4, int(4 * len(self.keys)).bit_length())) - 1)
            self.slots = np.full(int(self.mask) + 1, -1, np.int32)
            self.slot_key = np.zeros(int(self.mask) + 1, np.uint64)
            old = 0
        todo = np.arange(old, len(self.keys), dtype=np.int32)
        place = self.keys[old:] & self.mask
        while len(todo):
            free = self.slots[place] < 0
            self.slots[place[free]] = todo[free]  # of several for one slot the last stays
            self.slot_key[place[free]] = self.keys[todo[free]]
            left = self.slots[place] != todo
            todo, place = todo[left], (place[left] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, or -1."""
        place = keys & self.mask
        found = self.slots[place]
        wrong = np.flatnonzero((found >= 0) & (self.slot_key[place] != keys))
        while len(wrong):
            place[wrong] = (place[wrong] + np.uint64(1)) & self.mask
            now = self.slots[place[wrong]]
            found[wrong] = now
            wrong = wrong[(now >= 0) & (self.slot_key[place[wrong]] != keys[wrong])]
        return found


def signed(h: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's long."""
    return h.view(np.int64)
