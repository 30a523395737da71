"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of SIMILARITY or more, by SimHash.

A text has several SimHash fingerprints: one of its whole set, and ``SAMPLES`` of min-wise samples of
``ROWS`` of its shingles each, majority bits of the sampled hashes. The vantage-point trees of
``simhash`` link all fingerprints within ``DISTANCE`` bits of each other, and texts with linked
fingerprints are candidates. One fingerprint of the whole set loses most pairs of similarity 0.8 (they
differ in about ten bits); two texts of similarity s draw the same sample with probability s ** ROWS,
so that they share none with (1 - s ** ROWS) ** SAMPLES, 0.0004 at 0.8.

Every candidate is checked on the sets themselves. Texts of a group of linked fingerprints are first
compared with one of them only; a group that is still in several components is then compared whole,
in blocks of about ``BLOCK`` texts or ``BLOCK_SHINGLES`` shingles, if those are fewer texts: a task takes
two blocks, counts what their sets share over ``COLUMNS`` shingles at a time, and gives only the links found.

Defined results: words are lower-cased A-Z and cut at ASCII white space; a text of fewer words is one
shingle; null, empty and blank texts are copies of each other; null and repeated ids are kept apart by
their texts; other columns stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import BASE, Words, forget, mix, pieces, saved, signed, utf8
from tickloom.llm.simhash import HOT, components, link

SHINGLE = 5
#: Similarity as a fraction of integers.
SIMILARITY = (4, 5)
ROWS, SAMPLES, DISTANCE, BLOCK = 5, 20, 1, 96
#: Shingles of a block, about, and those that a matrix of texts and shingles has columns for.
BLOCK_SHINGLES, COLUMNS = 1 << 19, 1 << 15

_seeds = np.random.default_rng(17).integers(0, 1 << 63, (2, SAMPLES, ROWS), np.uint64)
_seeds[0] |= np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in order, and where each text's begin."""
    words = Words(data, offsets)
    h, size = words.hashes(), np.diff(words.first)
    text = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(h)) - words.first[text]
    left = size[text] - place
    grown = h.copy()
    for k in range(1, SHINGLE):
        more = np.flatnonzero(left > k)
        grown[more] = mix(grown[more] * np.uint64(BASE) + h[more + k])
    keep = (place == 0) | (left >= SHINGLE)
    text, h = text[keep], grown[keep]
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    if len(h):
        new = np.concatenate([[True], (np.diff(text) != 0) | (h[1:] != h[:-1])])
        text, h = text[new], h[new]
    return h, np.searchsorted(text, np.arange(len(size) + 1))


def majority(x: list[np.ndarray]) -> np.ndarray:
    """The bits that over half of five values have, all 64 at once."""
    a, b, c, d, e = x
    one, carry = a ^ b ^ c, a & b | c & (a ^ b)
    last, more = one ^ d ^ e, one & d | e & (one ^ d)
    return carry & more | (carry ^ more) & last


def fingerprints(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A row of fingerprints for each set; set i begins at begin[i] of h, and none is empty."""
    size = np.diff(np.append(begin, len(h)))
    out = np.zeros((len(begin), SAMPLES + 1), np.uint64)
    for i in range(0, len(begin), 256):
        lo, hi = begin[i], begin[i + 256] if i + 256 < len(begin) else len(h)
        ones = np.add.reduceat(np.unpackbits(h[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), begin[i : i + 256] - lo, axis=0, dtype=np.int32)
        out[i : i + 256, 0] = np.packbits(2 * ones > size[i : i + 256, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    for k in range(SAMPLES):
        out[:, k + 1] = majority([mix(np.minimum.reduceat((h ^ _seeds[1, k, r]) * _seeds[0, k, r], begin)) for r in range(ROWS)])
    return out


def sketches(batches):
    """Task over (doc_id, text_hash, text): each row with the hash of its set, the set (low halves of its hashes) and its fingerprints."""
    for batch in batches:
        for i, j, data, offsets in pieces(*utf8(batch.column(2))):
            h, first = shingle_sets(data, offsets)
            size = np.diff(first)
            full = np.flatnonzero(size)
            sid, prints = np.zeros(j - i, np.uint64), np.zeros((0, SAMPLES + 1), np.uint64)
            if len(full):
                begin = first[:-1][full]
                sid[full] = mix(np.add.reduceat(mix(h), begin) + size[full].astype(np.uint64))
                prints = fingerprints(h, begin)
            n = np.where(size > 0, SAMPLES + 1, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[i:j], batch.column(1)[i:j], pa.array(signed(sid)),
                    pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h.astype(np.uint32).view(np.int32))),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(signed(np.ascontiguousarray(prints).ravel()))),
                ],
                names=["doc_id", "text_hash", "sid", "members", "prints"],
            )


def with_hot(rows: DataFrame, per_key: DataFrame, key: str, n: int) -> DataFrame:
    """rows joined with per_key (key, n, ...) by key; keys of over 1 / HOT of the n rows by broadcast: there are fewer than HOT of them."""
    is_hot = F.col("n") > max(HOT, n / HOT)
    hot = F.broadcast(per_key.where(is_hot))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(per_key.where(~is_hot), key))


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) those whose sets are as similar as SIMILARITY."""
    up, down = SIMILARITY
    both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("sid").alias("b"), F.col("members").alias("y")), "b")
    shared, total = F.size(F.array_intersect("x", "y")), F.size(F.array_distinct("x")) + F.size(F.array_distinct("y"))
    return both.where((up + down) * shared >= up * total).select("a", "b")


def block_links(group: pa.Table) -> pa.Table:
    """Links between the sets of two blocks (or of one), enough to connect all components that links between those sets connect."""
    up, down = SIMILARITY
    sid, root, block = (group[c].to_numpy() for c in ("sid", "root", "block"))
    lists = [np.unique(x) for x in group["members"].to_numpy()]
    size = np.array([len(x) for x in lists])
    _, word = np.unique(np.concatenate(lists), return_inverse=True)
    text, order = np.repeat(np.arange(len(lists)), size), np.argsort(word, kind="stable")
    text, word = text[order], word[order]
    first, second = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    shared, has = np.zeros((len(first), len(second))), np.zeros((len(lists), COLUMNS), np.float32)
    for low in range(0, int(word.max(initial=-1)) + 1, COLUMNS):
        own = slice(*np.searchsorted(word, [low, low + COLUMNS]))
        has[text[own], word[own] - low] = 1
        shared += has[first] @ has[second].T
        has[text[own], word[own] - low] = 0
    close = ((up + down) * shared >= up * (size[first][:, None] + size[second][None, :])) & (root[first][:, None] != root[second][None, :])
    x, y = np.nonzero(close)
    x, y = first[x], second[y]
    # one link for two components, and none for those that other links connect
    low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
    kept, leader = [], {}
    for k in np.unique(np.stack([low, high]), axis=1, return_index=True)[1].tolist():
        a, b = int(low[k]), int(high[k])
        while leader.get(a, a) != a:
            a = leader[a]
        while leader.get(b, b) != b:
            b = leader[b]
        if a != b:
            leader[b] = a
            kept.append(k)
    return pa.table({"a": sid[x[kept]], "b": sid[y[kept]]})


def roots(rows: DataFrame) -> DataFrame:
    """(sid, root) of the sets of rows (row, sid, members, prints) that have near copies."""
    own = saved(rows.select("sid", F.size("members").alias("size"), F.explode("prints").alias("fp")).distinct(), "set-prints")
    prints = saved(own.groupBy("fp").agg(F.count("*").alias("n")), "prints")
    linked = components(link(prints, DISTANCE)).select(F.col("v").alias("fp"), F.col("root").alias("to"))
    # a fingerprint of many sets or one that is linked: the others tell nothing
    named = saved(prints.join(linked, "fp", "left").where("n > 1 or to is not null").select("fp", "n", F.coalesce("to", "fp").alias("key")), "print-keys")
    total = own.count()
    keys = saved(with_hot(own, named, "fp", total).select("key", "sid", "size").distinct(), "keys")
    per_key = saved(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("sid").alias("first")).where("n > 1"), "key-sizes")
    grouped = saved(with_hot(keys, per_key, "key", total), "grouped")
    known = rows.groupBy("sid").agg(F.min("row").alias("row")).join(grouped.select("sid").distinct(), "sid").select("row")
    sets = saved(rows.join(known, "row", "left_semi").select("sid", "members"), "sets")
    links = saved(alike(grouped.where("sid != first").select(F.col("first").alias("a"), F.col("sid").alias("b")).distinct(), sets), "alike")
    found = saved(components(links).select(F.col("v").alias("sid"), "root"), "first-roots")
    placed = grouped.drop("first", "n").join(found, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    placed = saved(placed, "placed")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    open_keys = placed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key", blocks.alias("blocks"), "n")
    members = with_hot(placed, saved(open_keys, "open-keys"), "key", total).withColumn("block", F.pmod(F.xxhash64("sid", "key"), F.col("blocks")).cast("int"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sid", "root")
    more = dealt.join(sets, "sid").groupBy("key", "i", "j").applyInArrow(block_links, "a long, b long")
    links = links.unionByName(saved(more, "alike-rest"))
    result = saved(components(links).select(F.col("v").alias("sid"), "root"), "roots")
    forget(own, prints, named, keys, per_key, grouped, sets, found, placed)
    return result


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Of each component of near copies the row with the smallest doc_id stays (nulls last; of several with that id, the one with the smallest text hash)."""
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = saved(own.mapInArrow(sketches, f"doc_id {kind}, text_hash long, sid long, members array<int>, prints array<long>").withColumn("row", F.monotonically_increasing_id()), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    least = rows.groupBy("sid").agg(first.alias("least")).join(roots(rows), "sid", "left")
    kept = least.groupBy(F.coalesce("root", "sid").alias("root")).agg(F.min("least").alias("k")).select(F.col("k.doc_id").alias("k_id"), F.col("k.text_hash").alias("k_hash"))
    kept = saved(kept, "kept-ids")
    forget(rows)
    names = docs.columns
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.xxhash64("text").alias("h"))
    one = marked.join(kept, F.col("row.doc_id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_hash")), "left_semi")
    return one.withColumn("id", F.col("row.doc_id")).dropDuplicates(["id", "h"]).select("row.*")
