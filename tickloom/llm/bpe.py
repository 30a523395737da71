"""Byte-level BPE encoding and decoding; long unsplit text by tree concatenation.

A text is cut at the strings of special tokens and by the tokenizer's pattern into pretokens; the
classes of characters that the pattern needs are asked from the tokenizers library itself. The
library encodes each distinct short pretoken once per worker. A pretoken of over ``LONG`` characters
is cut in halves down to leaves; the library encodes the leaves, and neighbours are joined bottom up:
the ids next to the join are decoded and encoded again in a growing window, until the window's first
and last ids are those that were there. Then every pair of neighbouring ids is one that BPE leaves
alone, which makes the joined ids those of the whole.

Texts of over ``BIG`` characters are encoded in parallel: their parts, of whole pretokens or of pieces
of a long one, are dealt to tasks, and the same joins make one list of the parts' ids.

Decoding maps each id to its bytes and reads them as UTF-8.

Defined results: null and empty texts have no ids; repeated rows get equal results; other columns
aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import IdMemory, ragged, saved, table
from tickloom.llm.token_files import tokenizer_path

# Fixed value: the pretoken pattern that this tokenizer's published description gives; ``pretokens`` cuts by it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a pretoken that is encoded in parts, and of a leaf.
LONG, LEAF = 1024, 256
#: Characters of a text whose parts are dealt to tasks, and of a part, about.
BIG, PART = 1 << 19, 1 << 17
#: Distinct pretokens that a worker remembers.
MAX_PRETOKENS = 1 << 20
#: New pretokens that the library encodes at once.
AT_ONCE = 4096
#: Ids on each side of a join that the first window takes.
WINDOW = 8


SPACE_CLASS, LETTER_CLASS, NUMBER_CLASS, OTHER_CLASS, UNKNOWN_CLASS = range(5)
#: Code points whose classes are asked for at once.
PAGE = 256


class CharClasses:
    """The pattern's class of code points, asked from the library's own cutting a page at a time, when a text first has one of it.

    A letter next to "a", a number next to "1" and another sign next to "!" stay in one pretoken; a space does so with none."""

    PROBES = ((LETTER_CLASS, "a"), (NUMBER_CLASS, "1"), (OTHER_CLASS, "!"))

    def __init__(self, library):
        self.cut = library.pre_tokenizer.pre_tokenize_str
        self.table = np.full(0x110000, UNKNOWN_CLASS, np.uint8)

    def __call__(self, chars: np.ndarray) -> np.ndarray:
        kind = self.table[chars]
        new = np.unique(chars[kind == UNKNOWN_CLASS] // PAGE)
        for page in new.tolist():
            self.ask(page * PAGE)
        return self.table[chars] if len(new) else kind

    def ask(self, first: int) -> None:
        codes = np.array([c for c in range(first, first + PAGE) if not 0xD800 <= c < 0xE000], np.int64)
        self.table[codes] = SPACE_CLASS
        for kind, probe in self.PROBES:
            begins = np.zeros(2 * len(codes) + 1, bool)
            begins[[a for _, (a, _) in self.cut("".join(probe + chr(c) for c in codes))]] = True
            self.table[codes[~begins[1::2]]] = kind


def pretokens(chars: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pretokens begin in code points of texts that begin at ``first`` (one more at the end), as PATTERN cuts them."""
    n = len(chars)
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    new = begins[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    # the last of the spaces before something else: it stands alone, or, if a plain space, goes with what follows
    last = np.flatnonzero((kind[:-1] == SPACE_CLASS) & (kind[1:] != SPACE_CLASS) & ~begins[1:n]) if n else np.zeros(0, np.int64)
    new[last] = True
    new[last[chars[last] == 0x20] + 1] = False
    # 's, 't, 'm, 'd, 're, 've and 'll where a pretoken begins
    mark = np.flatnonzero((chars == 0x27) & new)
    mark = mark[mark + 1 < n]
    mark = mark[~begins[mark + 1]]
    one = chars[mark + 1]
    two = np.where((mark + 2 < n) & ~begins[np.minimum(mark + 2, n)], chars[np.minimum(mark + 2, n - 1)], 0)
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    size = np.where(single, 2, np.where(double, 3, 0))
    mark, size = mark[size > 0], size[size > 0]
    new[mark + 1] = False
    after = (mark + size)[mark + size < n]
    new[after] = True
    return np.flatnonzero(new)


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable bytes for themselves, the others by rising code points from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark keeps the cores busy
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        of = byte_of_char()
        self.bytes_of = {i: bytes(of[c] for c in token) for token, i in model["model"]["vocab"].items() if all(c in of for c in token)}
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in special.items()}
        self.special = special
        self.cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.id_of_byte = {b[0]: i for i, b in sorted(self.bytes_of.items(), reverse=True) if len(b) == 1}
        vocab = model["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.memory = IdMemory(MAX_PRETOKENS)
        self.classes = CharClasses(self.library)
        top = max(self.bytes_of) + 1
        self.token_begin = np.concatenate([[0], np.cumsum([len(self.bytes_of.get(i, b"")) for i in range(top)])])
        self.token_bytes = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(top)), np.uint8)
        digits = [b"%d," % i for i in range(top)]
        self.digit_begin = np.concatenate([[0], np.cumsum([len(d) for d in digits])])
        self.digit_bytes = np.frombuffer(b"".join(digits), np.uint8)

    # ids of bytes, as the definition says: the lowest-ranked pair first, of equal ones the leftmost

    def merge_bytes(self, data: bytes) -> list[int]:
        ids = [self.id_of_byte[b] for b in data]
        after, before, alive = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), [True] * len(ids)
        heap = [(m[0], k, m[1], ids[k], ids[k + 1]) for k in range(len(ids) - 1) if (m := self.merges.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, new, a, b = heapq.heappop(heap)
            n = after[k] if alive[k] else len(ids)
            if n >= len(ids) or ids[k] != a or ids[n] != b:
                continue
            ids[k], alive[n] = new, False
            after[k] = after[n]
            if after[k] < len(ids):
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < len(ids) and (m := self.merges.get((ids[left], ids[after[left]]))):
                    heapq.heappush(heap, (m[0], left, m[1], ids[left], ids[after[left]]))
        return [i for i, a in zip(ids, alive, strict=True) if a]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of the bytes of both, given the ids of each."""
        w = WINDOW
        while True:
            a, b = left[-w:], right[:w]
            ids = self.merge_bytes(b"".join(self.bytes_of[i] for i in [*a, *b]))
            if (len(a) == len(left) or ids[0] == a[0]) and (len(b) == len(right) or ids[-1] == b[-1]) and len(ids) > 1 or len(a) == len(left) and len(b) == len(right):
                return left[: len(left) - len(a)] + ids + right[len(b) :]
            w *= 2

    def encode_long(self, pretoken: str) -> list[int]:
        """Tree concatenation."""
        parts = 1 << max(0, (len(pretoken) - 1) // LEAF).bit_length()
        cuts = [len(pretoken) * k // parts for k in range(parts + 1)]
        leaves = [e.ids for e in self.library.encode_batch_fast([pretoken[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], add_special_tokens=False)]
        while len(leaves) > 1:
            leaves = [self.join(leaves[k], leaves[k + 1]) for k in range(0, len(leaves), 2)]
        return leaves[0]

    def cut_text(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(code points of all texts, where each text begins, where each piece begins, the id of a piece that is a special token's string or else -1).

        Pieces are pretokens and special tokens' strings; one more begin stands at the end of all."""
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        whole = "".join(texts)
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        bounds, special = [first[:-1]], {}
        if self.cut is not None and any(t in whole for t in self.special):
            for at, text in zip(first.tolist(), texts, strict=False):
                for m in self.cut.finditer(text):
                    special[at + m.start()] = self.special[m[0]], at + m.end()
            bounds += [np.array([x for a, (_, b) in special.items() for x in (a, b)], np.int64)]
        begins = np.unique(np.concatenate(bounds))
        start = pretokens(chars, self.classes(chars), np.append(begins[begins < len(chars)], len(chars)))
        of = np.full(len(start), -1, np.int64)
        if special:
            own = np.ones(len(start), bool)
            for a, (i, b) in special.items():
                lo, hi = np.searchsorted(start, (a, b))
                own[lo + 1 : hi] = False
                of[lo] = i
            start, of = start[own], of[own]
        return chars, first, np.append(start, len(chars)), of

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin."""
        chars, first, start, special = self.cut_text(texts)
        size = np.diff(start)
        alone = (special >= 0) | (size > LONG)
        place = np.concatenate([[0], np.cumsum(1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000).astype(np.int64))])
        raw = "".join(texts).encode()
        usual = ~alone
        begin, stop = place[start[:-1][usual]], place[start[1:][usual]]

        def encode(k: np.ndarray) -> list[list[int]]:
            found = []
            for at in range(0, len(k), AT_ONCE):
                own = k[at : at + AT_ONCE]
                words = [raw[a:b].decode() for a, b in zip(begin[own].tolist(), stop[own].tolist(), strict=True)]
                found += [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
            return found

        ids, by_piece = self.memory.ids_of(np.frombuffer(raw, np.uint8), begin, stop, encode)
        at = np.searchsorted(start[:-1], first)
        if not alone.any():
            return ids, by_piece[at]
        count = np.zeros(len(size), np.int64)
        count[usual] = np.diff(by_piece)
        own = {k: [int(special[k])] if special[k] >= 0 else self.encode_long(raw[place[start[k]] : place[start[k + 1]]].decode()) for k in np.flatnonzero(alone).tolist()}
        parts, done = [], 0
        usual_before = np.concatenate([[0], np.cumsum(usual)])
        for k, found in own.items():
            count[k] = len(found)
            parts += [ids[done : by_piece[usual_before[k]]], np.array(found, np.int32)]
            done = by_piece[usual_before[k]]
        return np.concatenate([*parts, ids[done:]]), np.concatenate([[0], np.cumsum(count)])[at]

    def parts_of(self, text: str) -> list[tuple[str, bool]]:
        """A long text in parts of about PART characters, and whether each goes on with the pretoken of the part before it."""
        _, _, start, special = self.cut_text([text])
        parts: list[tuple[str, bool]] = []
        held = 0
        for a, b, of in zip(start[:-1].tolist(), start[1:].tolist(), special.tolist(), strict=True):
            if of < 0 and b - a > 2 * PART:
                if a > held:
                    parts.append((text[held:a], False))
                pieces = -(-(b - a) // PART)
                cuts = [a + (b - a) * k // pieces for k in range(pieces + 1)]
                parts += [(text[x:y], k > 0) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
                held = b
            elif b - held >= PART:
                parts.append((text[held:b], False))
                held = b
        if held < len(text):
            parts.append((text[held:], False))
        return parts

    def encode_part(self, text: str, inside: bool) -> list[int]:
        """The ids of a part; inside: it is a piece of one pretoken, and not cut again."""
        return self.encode_long(text) if inside else self.encode_texts([text])[0].tolist()

    def join_parts(self, parts: list[list[int]], goes_on: list[bool]) -> list[int]:
        """The ids of a text from those of its parts: parts of one pretoken are joined as a tree, then all follow each other."""
        out: list[int] = []
        k = 0
        while k < len(parts):
            end = k + 1
            while end < len(parts) and goes_on[end]:
                end += 1
            own = parts[k:end]
            while len(own) > 1:
                own = [self.join(own[j], own[j + 1]) if j + 1 < len(own) else own[j] for j in range(0, len(own), 2)]
            out += own[0]
            k = end
        return out

    def texts_of(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """The decoded texts of runs of ids."""
        take, place = ragged(self.token_begin[ids], self.token_begin[ids + 1] - self.token_begin[ids])
        data, bounds = self.token_bytes[take].tobytes(), place[first].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def digits_of(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """Runs of ids as decimal numbers with commas between them."""
        take, place = ragged(self.digit_begin[ids], self.digit_begin[ids + 1] - self.digit_begin[ids])
        data, bounds = self.digit_bytes[take].tobytes(), place[first].tolist()
        return [data[a : max(a, b - 1)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This worker's codec."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def runs(texts: list[str], most: int = 1 << 19):
    """Runs of whole texts of about ``most`` characters."""
    at = held = 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= most:
            yield texts[at : k + 1]
            at, held = k + 1, 0
    if at < len(texts):
        yield texts[at:]


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def runs_of(column: pa.Array, rows: int = 256):
    """Runs of a text column's texts, some rows at a time: not all of a batch become strings at once."""
    for at in range(0, len(column), rows):
        yield from runs(_texts(column.slice(at, rows)))


def lists(ids: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))


def encode_udf(path: str):
    """A column function: text -> array of ids."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        found = [lists(*codec(path).encode_texts(part)) for part in runs_of(texts)]
        return pa.concat_arrays(found) if found else lists(np.zeros(0, np.int32), np.zeros(1, np.int64))

    return run


def decode_udf(path: str):
    """A column function: array of ids -> text; null for null."""

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        own = ids.fill_null([]) if ids.null_count else ids
        first, values, texts, k = own.offsets.to_numpy(), own.values.to_numpy(), [], 0
        while k < len(own):
            end = max(k + 1, int(np.searchsorted(first, first[k] + DIGEST_IDS, "right")) - 1)
            texts += codec(path).texts_of(values[first[k] : first[end]], first[k : end + 1] - first[k])
            k = end
        return pa.array(texts, pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False))

    return run


def digests_udf(path: str):
    """A column function: array of ids -> their number, and digests of them and of the text decoded from them."""

    @F.arrow_udf(DIGESTS)
    def run(ids: pa.Array) -> pa.Array:
        own = ids.fill_null([]) if ids.null_count else ids
        first, values, found, k = own.offsets.to_numpy(), own.values.to_numpy(), [], 0
        while k < len(own):  # some texts at a time: their bytes are addressed one by one
            end = max(k + 1, int(np.searchsorted(first, first[k] + DIGEST_IDS, "right")) - 1)
            found.append(digests(codec(path), values[first[k] : first[end]], first[k : end + 1] - first[k]))
            k = end
        return pa.concat_arrays(found) if found else digests(codec(path), np.zeros(0, np.int64), np.zeros(1, np.int64))

    return run


#: Ids that are decoded and hashed at once, about.
DIGEST_IDS = 1 << 18
DIGESTS = "struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>"


def digests(own: Codec, ids: np.ndarray, first: np.ndarray) -> pa.StructArray:
    a = [hashlib.sha256(x).hexdigest() for x in own.digits_of(ids, first)]
    b = [hashlib.sha256(x.encode()).hexdigest() for x in own.texts_of(ids, first)]
    return pa.StructArray.from_arrays([pa.array(np.diff(first), pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip_udf(path: str):
    """A column function: text -> digests of its ids and of their decoded text, without keeping the ids."""

    @F.arrow_udf(DIGESTS)
    def run(texts: pa.Array) -> pa.Array:
        own = codec(path)
        found = [digests(own, *own.encode_texts(part)) for part in runs_of(texts)]
        return pa.concat_arrays(found) if found else digests(own, np.zeros(0, np.int64), np.zeros(1, np.int64))

    return run


def count_udf(path: str):
    """A column function: text -> number of ids."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0, np.int64), *(np.diff(codec(path).encode_texts(part)[1]) for part in runs_of(texts))]))

    return run


def encode_big(docs: DataFrame, path: str) -> DataFrame:
    """docs with ``ids``, the ids of its column text, for long texts: parts are encoded side by side, and joined by text."""
    kept = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                parts = codec(path).parts_of(batch.column(1)[k].as_py())
                number = str(uuid.uuid4())
                for at in range(0, len(parts), 16):
                    own = parts[at : at + 16]
                    n = len(own)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([k] * n)), pa.array([number] * n), pa.array(range(at, at + n), pa.int32()), pa.array([t for t, _ in own], pa.string()),
                            pa.array([g or at + j + 1 < len(parts) and parts[at + j + 1][1] for j, (_, g) in enumerate(own)]), pa.array([g for _, g in own]),
                        ],
                        names=["row", "number", "part", "text", "inside", "goes_on"],
                    )

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array, inside: pa.Array) -> pa.Array:
        return pa.array([codec(path).encode_part(t, i) for t, i in zip(texts.to_pylist(), inside.to_pylist(), strict=True)], pa.list_(pa.int32()))

    @F.arrow_udf("array<int>")
    def join(parts: pa.Array) -> pa.Array:
        return pa.array([codec(path).join_parts([x["ids"] for x in row], [x["goes_on"] for x in row]) for row in parts.to_pylist()], pa.list_(pa.int32()))

    dealt = saved(rows.mapInArrow(cut, f"row {kind}, number string, part int, text string, inside boolean, goes_on boolean"), "bpe-parts")
    encoded = dealt.repartition(F.col("number"), F.col("part")).select("row", "number", F.struct("part", encode("text", "inside").alias("ids"), "goes_on").alias("p"))
    whole = encoded.groupBy("number").agg(F.any_value("row").alias("row"), F.sort_array(F.collect_list("p")).alias("parts"))  # the parts of one text
    return whole.select("row.*", join("parts").alias("ids"))


def is_big() -> Column:
    return F.coalesce(F.length("text") > BIG, F.lit(False))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs (with any columns) with ``ids`` in place of ``text``."""
    usual = docs.where(~is_big()).withColumn("ids", encode_udf(path)(F.col("text").cast("string"))).drop("text")
    return usual.unionByName(encode_big(docs.where(is_big()), path))


def lengths(docs: DataFrame, path: str) -> DataFrame:
    """(n_tokens) of every row of docs (text)."""
    usual = docs.where(~is_big()).select(count_udf(path)(F.col("text").cast("string")).alias("n_tokens"))
    return usual.unionByName(encode_big(docs.where(is_big()).select("text", F.lit(0).alias("_")), path).select(F.size("ids").cast("long").alias("n_tokens")))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    usual = docs.where(~is_big()).select("doc_id", round_trip_udf(path)("text").alias("r"))
    big = encode_big(docs.where(is_big()), path).select("doc_id", digests_udf(path)("ids").alias("r"))
    return usual.unionByName(big).select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
