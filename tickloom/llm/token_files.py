"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are counted over all documents and replaced by their rank, so frequent ids take one byte. A
rank takes one to four bytes; the lengths of four ranks stand in one byte of a separate control
stream, and a numpy table that is addressed by the control byte gives the places of all four.

Files: Parquet, in ``blocks`` one folder per shard, shards and the rows in them in ascending doc_id
order; an id, or no id, with more text than a shard has several, dealt by text. A row is a block of whole documents: ``start`` (ids of the shard before it), ``doc_ids``,
``sizes`` (ids of each document), ``control`` and ``data``. The first ids of the shards follow from
their sizes. ``ranks`` holds the id of each rank; the folder is all that readers need.

A text is cut into words at ASCII white space, where this kind of tokenizer never joins tokens, and
each distinct word, as it is written, is encoded by the tokenizers library once per worker.

Defined results: null texts are empty and hold only the end id; null ids come first; equal ids are
in any order. An empty table gives no rows. Special tokens' strings in a text are
what the library makes of them: such texts are encoded as a whole.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import IdMemory, Words, forget, Shards, new_path, pieces, saved, table, utf8

END_ID = 1
#: Distinct words that a worker remembers, at most, and ids in a block, about.
MAX_WORDS, BLOCK_IDS = 1 << 20, 1 << 16


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


PUNCTUATION, ALPHANUMERIC = np.zeros(256, bool), np.zeros(256, bool)
PUNCTUATION[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True
ALPHANUMERIC[[b for b in range(128) if chr(b).isalnum()]] = True
AS_IS = np.arange(256, dtype=np.uint8)
BLOCKS = "shard int, start long, doc_ids array<long>, sizes array<long>, control binary, data binary"


def without_tails(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of words, of which up to three punctuation marks after an ASCII letter or digit are words of their own: the tokenizer cuts there too."""
    size, tail = words.end - words.start, np.zeros(len(words), np.int64)
    for k in range(1, 4):
        longer = (tail == k - 1) & (size > k)
        longer[longer] = PUNCTUATION[words.low[words.end[longer] - k]]
        tail[longer] = k
    ends_there = tail > 0
    ends_there[ends_there] = ALPHANUMERIC[words.low[words.end[ends_there] - tail[ends_there] - 1]]
    place = np.arange(len(words) + 1) + np.concatenate([[0], np.cumsum(ends_there)])
    start, end = np.empty(place[-1], np.int64), np.empty(place[-1], np.int64)
    cut = words.end - np.where(ends_there, tail, 0)
    start[place[:-1]], end[place[:-1]] = words.start, cut
    start[place[:-1][ends_there] + 1], end[place[:-1][ends_there] + 1] = cut[ends_there], words.end[ends_there]
    return start, end, place[words.first]


class WordEncoder:
    """Encodes texts word by word, remembering the ids of each distinct word."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark keeps the cores busy
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.memory = IdMemory(MAX_WORDS)

    def encode_each(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin (one more at the end)."""
        raw = data.tobytes()
        if any(s in raw for s in self.special):
            found = self.encode_each([raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            return np.array([x for ids in found for x in ids], np.int32), np.concatenate([[0], np.cumsum([len(ids) for ids in found])])
        words = Words(data, offsets, AS_IS)
        start, end, begins = without_tails(words)
        ids, first = self.memory.ids_of(data, start, end, lambda at: self.encode_each([raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]))
        return ids, first[begins]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with the end id after each text's."""
    return np.insert(ids, first[1:], end), first + np.arange(len(first))


# The coding

_sizes = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) % 4 + 1
CODE_SIZE = _sizes.astype(np.uint8)
CODE_PLACE = (np.cumsum(_sizes, 1) - _sizes).astype(np.int64)
CODE_TOTAL = _sizes.sum(1).astype(np.int64)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values; the last control byte may count up to three zeros of one byte each."""
    values = np.concatenate([values.astype("<u4"), np.zeros(-len(values) % 4, "<u4")])
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    control = ((size - 1).reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes) -> np.ndarray:
    """All values, those that fill up included."""
    code, data = np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8)
    begin = np.cumsum(CODE_TOTAL[code]) - CODE_TOTAL[code]
    place, size = (begin[:, None] + CODE_PLACE[code]).ravel(), CODE_SIZE[code].ravel()
    values = data[place].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        values[more] |= data[place[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


# The jobs


def token_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def encode_documents(path: str, end: int, shards: Shards):
    """Task over (doc_id, text): the shard of each document and its ids, the end id included."""

    def run(batches):
        own = encoder(path)
        kind = token_type(own.size)
        for batch in batches:
            ids = batch.column(0)
            shard = shards.of(ids, batch.column(1))
            for i, j, data, offsets in pieces(*utf8(batch.column(1))):
                tokens, first = with_end(*own.encode(data, offsets), end)
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(first * int(kind[2])), pa.py_buffer(tokens.astype(kind))])
                yield pa.RecordBatch.from_arrays([ids[i:j], pa.array(shard[i:j]), raw.cast(pa.binary())], names=["doc_id", "shard", "ids"])

    return run


def count_ids(kind: str):
    def run(batches):
        counts = np.zeros(1 << 8, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                own = np.bincount(np.frombuffer(raw.as_buffer(), kind), minlength=len(counts))
                own[: len(counts)] += counts
                counts = own
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(counts[ids])], names=["id", "n"])

    return run


def ranked_ids(tokens: DataFrame, kind: str) -> np.ndarray:
    """All ids of the documents by falling count, then rising id; their number is bounded by the vocabulary."""
    counts = tokens.select("ids").mapInArrow(count_ids(kind), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").toArrow()
    return counts["id"].to_numpy()


def pack_documents(kind: str, by_rank):
    def run(batches):
        rank = np.zeros(int(by_rank.value.max(initial=0)) + 1, np.uint32)
        rank[by_rank.value] = np.arange(len(by_rank.value), dtype=np.uint32)
        for batch in batches:
            coded = [pack(rank[np.frombuffer(raw.as_buffer(), kind)]) for raw in batch.column(2)]
            size = [raw.as_buffer().size // int(kind[2]) for raw in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array([c for c, _ in coded], pa.binary()), pa.array([d for _, d in coded], pa.binary())], names=["doc_id", "shard", "size", "control", "data"])

    return run


def join_blocks(batches):
    """Task over documents sorted by shard and id: blocks of them."""
    rows: list[tuple] = []
    held = 0
    start, shard = 0, None

    def block() -> pa.RecordBatch:
        ids, sizes, control, data = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([start], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(control)], pa.binary()), pa.array([b"".join(data)], pa.binary())],
            names=["shard", "start", "doc_ids", "sizes", "control", "data"],
        )

    for batch in batches:
        for doc_id, own, size, control, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if rows and (own != shard or held >= BLOCK_IDS):
                yield block()
                start, rows, held = start + held, [], 0
            if own != shard:
                shard, start = own, 0
            rows.append((doc_id, size, control, data))
            held += size
    if rows:
        yield block()


def write_files(docs: DataFrame, out: str, path: str, end: int = END_ID) -> None:
    """Write the ids of docs (doc_id, text) and the ids by rank to the folder out."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = Shards(docs)
    kind = token_type(encoder(path).size)
    tokens = saved(docs.mapInArrow(encode_documents(path, end, shards), "doc_id long, shard int, ids binary"), "tokens", compression="zstd")
    ranks = ranked_ids(tokens, kind)
    spark.createDataFrame(pa.table({"rank": np.arange(len(ranks), dtype=np.int32), "id": ranks.astype(np.int32)})).coalesce(1).write.parquet(f"{out}/ranks")
    by_rank = spark.sparkContext.broadcast(ranks)
    coded = tokens.mapInArrow(pack_documents(kind, by_rank), "doc_id long, shard int, size long, control binary, data binary")
    ordered = coded.repartitionById(shards.n, "shard").sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "control", "data")
    ordered.mapInArrow(join_blocks, BLOCKS).write.partitionBy("shard").parquet(f"{out}/blocks")
    forget(tokens)


def digest(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def read_files(spark: SparkSession, out: str, of=digest, of_type: str = "long", name: str = "ids_crc32") -> DataFrame:
    """(doc_id, start, n_tokens, of(ids)) of every document in the files, ``of`` being a function of a document's ids."""
    ranks = spark.read.schema("rank int, id int").parquet(f"{out}/ranks").orderBy("rank").toArrow()["id"].to_numpy()  # as many as the vocabulary
    blocks = spark.read.schema(BLOCKS).parquet(f"{out}/blocks")
    ends = blocks.select("shard", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")).groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").toArrow()
    # a row for each shard
    shard, first = ends["shard"].to_numpy(), np.concatenate([[0], np.cumsum(ends["n"].to_numpy())])
    shared = spark.sparkContext.broadcast((shard, first, ranks.astype(np.uint32)))

    def run(batches):
        shards, firsts, by_rank = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                own, start, ids, sizes, control, data = (batch.column(c)[k] for c in range(6))
                sizes = np.array(sizes.as_py(), np.int64)
                values = by_rank[unpack(control.as_py(), data.as_py())]
                filled = -(-sizes // 4) * 4
                place = np.cumsum(filled) - filled
                begin = firsts[np.searchsorted(shards, own.as_py())] + start.as_py() + np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(begin), pa.array(sizes), pa.array([of(values[a : a + n]) for a, n in zip(place, sizes, strict=True)])], names=["doc_id", "start", "n_tokens", name])

    return blocks.select("shard", "start", "doc_ids", "sizes", "control", "data").mapInArrow(run, f"doc_id long, start long, n_tokens long, {name} {of_type}")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "token-files")
    write_files(table(spark, sf_dir, "documents"), out, tokenizer_path("word_bpe_49k.json"))
    return read_files(spark, out)
