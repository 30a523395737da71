"""SimHash near-duplicates, paired exactly by vantage-point trees over Hamming distance.

A fingerprint has bit b set if over half of the text's shingle hashes have it. Distinct
fingerprints are dealt to the leaves of a vantage-point tree that is built on a bounded sample;
a fingerprint outside a node's ball, but within ``distance`` of its border, goes to both sides, so
that by the triangle inequality every pair within ``distance`` meets in a leaf. A leaf that is too
large for a task is dealt again by a tree on a sample of its own; a dense cluster that no ball divides
is cut in blocks, and every pair of blocks is a leaf. Each leaf is searched by a tree of its own, with
the same bounds, and gives a spanning forest of its links, not all pairs. Links of all leaves are joined to components by alternating large-star and small-star
rounds, each written to the shared folder.

Defined results: null, empty and blank texts have fingerprint zero, linked like any other; a null
id never is the smallest unless all ids of a component are null; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import forget, pieces, saved, signed, table, utf8

SHINGLE, DISTANCE, SEED = 3, 2, 42
#: Fingerprints that the tree is built on, at most; those aimed at in a leaf; the least of the sample in a leaf.
SAMPLE, LEAF, LEAST_SAMPLE = 1 << 17, 4096, 24
#: Fingerprints of a leaf that isn't dealt again, those sampled from a larger one, and the share of it that its largest part must be under.
MOST_IN_LEAF, LEAF_SAMPLE, SHRINK = 1 << 17, 1024, 0.8
#: Within a leaf, runs up to this many are compared pair by pair.
BLOCK = 384
#: A fingerprint of over 1 / HOT of all rows is joined by broadcast: there are fewer than HOT of them.
HOT = 1000


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit fingerprints; nulls count as empty."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, _, data, offsets in pieces(*utf8(texts)):
        raw = data.tobytes().lower()  # bytes: A-Z only
        for row in range(len(offsets) - 1):
            words = raw[offsets[row] : offsets[row + 1]].split()
            if not words:
                continue
            joined = b" ".join(words)
            end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            start = np.concatenate([[0], end[:-1] + 1])
            k = min(shingle, len(words))
            start, end = start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist()
            ones = np.zeros(64, np.int64)
            for at in range(0, len(start), 1 << 15):
                h = np.array([digest(joined[a:b], SEED) for a, b in zip(start[at : at + (1 << 15)], end[at : at + (1 << 15)], strict=True)], np.uint64)
                ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[i + row] = np.packbits(2 * ones > len(start), bitorder="little").view(np.uint64)[0]
    return out


def fingerprint_udf(shingle: int = SHINGLE):
    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(signed(fingerprints(texts, shingle)))

    return run


class Tree:
    """Inner nodes of a vantage-point tree, in heap order: node i has children 2i+1 (inside its ball) and 2i+2."""

    def __init__(self, sample: np.ndarray, depth: int, distance: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        n = (1 << depth) - 1
        self.point, self.radius, self.depth, self.distance = np.zeros(n, np.uint64), np.full(n, 64, np.int16), depth, distance
        todo = [(0, sample)] if depth else []
        while todo:
            node, own = todo.pop()
            if len(own) < 2:
                continue
            self.point[node], self.radius[node] = best_ball(own, distance, rng)
            far = np.bitwise_count(own ^ self.point[node]) > self.radius[node]
            todo += [(x, y) for x, y in ((2 * node + 1, own[~far]), (2 * node + 2, own[far])) if x < n]

    def deal(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, leaf) of every value: one leaf for each, more for those near borders."""
        at, node = np.arange(len(values)), np.zeros(len(values), np.int64)
        for _ in range(self.depth):
            d = np.bitwise_count(values[at] ^ self.point[node]).astype(np.int16) - self.radius[node]
            near = (d > 0) & (d <= self.distance)
            node = np.concatenate([2 * node + 1 + (d > 0), 2 * node[near] + 1])
            at = np.concatenate([at, at[near]])
        return at, node


def best_ball(own: np.ndarray, distance: int, rng: np.random.Generator) -> tuple[np.uint64, int]:
    """Of some vantage points and radii that leave a third on either side, the ball with the fewest values just outside its border."""
    best = (2.0, own[0], 64)
    for point in rng.choice(own, min(6, len(own)), replace=False):
        counts = np.bincount(np.bitwise_count(own ^ point), minlength=65 + distance)
        inside = np.cumsum(counts) / len(own)
        for radius in np.flatnonzero((inside[:64] >= 0.3) & (inside[:64] <= 0.7)):
            border = inside[min(64, radius + distance)] - inside[radius]
            cost = border + abs(inside[radius] - 0.5) / 4
            if cost < best[0]:
                best = (cost, point, int(radius))
    if best[0] > 1:  # no radius divides it so: the one nearest to half
        point = own[0]
        inside = np.cumsum(np.bincount(np.bitwise_count(own ^ point), minlength=65)) / len(own)
        best = (0, point, int(np.argmin(np.abs(inside[:64] - 0.5))))
    return best[1], best[2]


def near_pairs(values: np.ndarray, distance: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (a, b), b < a, that connect all values which chains of pairs within distance connect."""
    if len(values) < 2:
        return
    if len(values) > BLOCK:
        point, radius = best_ball(values, distance, rng)
        d = np.bitwise_count(values ^ point)
        inner, outer = values[d <= radius + distance], values[d > radius]
        if max(len(inner), len(outer)) < 0.9 * len(values):
            yield from near_pairs(inner, distance, rng)
            yield from near_pairs(outer, distance, rng)
            return
    for i in range(0, len(values), BLOCK):  # also a dense cluster that no ball divides
        for j in range(i, len(values), BLOCK):
            yield from block_links(values[i : i + BLOCK], values[j : j + BLOCK] if j > i else None, distance)


def block_links(left: np.ndarray, right: np.ndarray | None, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    both = left if right is None else np.concatenate([left, right])
    close = np.bitwise_count(left[:, None] ^ both[None, :]) <= distance
    if np.count_nonzero(close) == len(left):  # each with itself only
        return
    row, column = np.nonzero(close)
    label = both.copy()
    while True:  # the smallest value reachable
        low = np.minimum(label[row], label[column])
        new = label.copy()
        np.minimum.at(new, row, low)
        np.minimum.at(new, column, low)
        if (new == label).all():
            break
        label = new
    moved = label != both
    if moved.any():
        yield both[moved], label[moved]


def leaf_links(distance: int):
    def run(group: pa.Table) -> pa.Table:
        values = np.unique(group["fp"].to_numpy().view(np.uint64))
        found = [np.stack(x) for x in near_pairs(values, distance, np.random.default_rng(7))]
        pairs = np.unique(np.concatenate([np.zeros((2, 0), np.uint64), *found], axis=1), axis=1)
        return pa.table({"a": signed(np.ascontiguousarray(pairs[0])), "b": signed(np.ascontiguousarray(pairs[1]))})

    return run


def deal_again(dealt: DataFrame, distance: int, most: int) -> DataFrame:
    """dealt (fp, leaf, n, was) with its leaves dealt on until none holds over ``most``; n and was are how many a leaf holds and the leaf that it came from held."""
    spark = dealt.sparkSession
    done: list[DataFrame] = []
    while True:
        large = F.col("n") > most
        dense = large & (F.col("n") > SHRINK * F.col("was"))
        blocks = F.ceil(F.col("n") / (most / 2)).cast("int")
        block = F.pmod(F.xxhash64("fp"), blocks).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.concat_ws(".", F.col("leaf"), F.least(block, x).cast("string"), F.greatest(block, x).cast("string")))
        done += [dealt.where(~large).select("fp", "leaf"), dealt.where(dense).select("fp", F.explode(pairs).alias("leaf"))]
        rest = dealt.where(large & ~dense)
        # at most LEAF_SAMPLE for each of few large leaves
        by_hash = F.row_number().over(Window.partitionBy("leaf").orderBy(F.xxhash64("fp")))
        sample = rest.where(F.pmod(F.xxhash64("fp", F.lit(3)), F.greatest(F.lit(1), F.floor(F.col("n") / (2 * LEAF_SAMPLE)))) == 0).withColumn("k", by_hash).where(F.col("k") <= LEAF_SAMPLE).select("leaf", "fp").toArrow()
        if not sample.num_rows:
            break
        names, values = np.array(sample["leaf"].to_pylist()), sample["fp"].to_numpy().view(np.uint64)
        trees = spark.sparkContext.broadcast({str(x): Tree(values[names == x], 5, distance) for x in np.unique(names)})

        def run(batches, trees=trees):
            for batch in batches:
                fp, leaf = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist())
                for x in np.unique(leaf):
                    own = fp[leaf == x]
                    at, node = trees.value[str(x)].deal(own.view(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array([f"{x}-{k}" for k in node]), pa.array(np.full(len(at), batch.column(2)[int(np.argmax(leaf == x))].as_py()))], names=["fp", "leaf", "was"])

        parts = saved(rest.select("fp", "leaf", "n").mapInArrow(run, "fp long, leaf string, was long"), "dealt-again")
        dealt = parts.join(F.broadcast(parts.groupBy("leaf").agg(F.count("*").alias("n"))), "leaf").select("fp", "leaf", "n", "was")  # a row for each leaf
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def link(distinct: DataFrame, distance: int = DISTANCE, most: int = MOST_IN_LEAF) -> DataFrame:
    """(a, b) links between distinct fingerprints (column fp), enough to connect all within that distance."""
    spark = distinct.sparkSession
    n = distinct.count()
    # about 2 * SAMPLE rows are sorted
    part = max(1, n // (2 * SAMPLE))
    sample = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(part)) == 0).orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toArrow()["fp"].to_numpy().view(np.uint64)
    depth = max(0, min(int(np.ceil(np.log2(max(1, n / LEAF)))), int(np.log2(max(1, len(sample) / LEAST_SAMPLE)))))
    tree = spark.sparkContext.broadcast(Tree(sample, depth, distance))

    def deal(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            at, leaf = tree.value.deal(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(leaf)], names=["fp", "leaf"])

    dealt = distinct.select("fp").mapInArrow(deal, "fp long, leaf long")
    if n > most:  # leaves may be too large
        dealt = saved(dealt, "dealt")
        sizes = dealt.groupBy("leaf").agg(F.count("*").alias("n"))
        if sizes.where(F.col("n") > most).limit(1).count():
            dealt = deal_again(dealt.join(F.broadcast(sizes), "leaf").select("fp", F.col("leaf").cast("string").alias("leaf"), "n", F.lit(n).cast("long").alias("was")), distance, most)
    return dealt.groupBy("leaf").applyInArrow(leaf_links(distance), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every end of the undirected edges (a, b): root is the smallest value of v's component."""

    def smallest(e: DataFrame) -> DataFrame:
        return e.groupBy("v").agg(F.min("u").alias("m"))

    edges = saved(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v != u").distinct(), "links")
    seen = None
    while True:
        # large star: neighbours above v are linked to the smallest of v and its neighbours
        both = edges.unionAll(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = smallest(both).select("v", F.least("v", "m").alias("m"))
        large = both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # small star: v and its neighbours below it are linked to the smallest of them
        large = saved(large, "large-star")
        forget(edges)
        low = smallest(large)
        small = large.join(low, "v").where("u != m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionAll(low.select("v", F.col("m").alias("u")))
        edges = saved(small.where("v != u").distinct(), "small-star")
        forget(large)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return edges.select("v", F.col("u").alias("root")).unionAll(edges.select(F.col("u").alias("v"), F.col("u").alias("root")).distinct())


def groups(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, component_id, n) of each distinct fingerprint of prints (doc_id, fp): the smallest doc_id of its component, and its rows."""
    own = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "prints")
    roots = components(link(own, distance)).select(F.col("v").alias("fp"), "root")
    linked = saved(own.join(roots, "fp"), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = linked.join(least, "root").select("fp", "component_id", "n")
    alone = own.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"), "n")
    return joined.unionAll(alone)


def with_component(prints: DataFrame, found: DataFrame) -> DataFrame:
    """prints with component_id. Fingerprints of very many rows are joined by broadcast, the others by shuffling."""
    rows = prints.count()
    hot = found.where(F.col("n") > max(HOT, rows / HOT)).select("fp", "component_id")
    hot = F.broadcast(hot)  # fewer than HOT rows, as each stands for over 1 / HOT of all
    usual = prints.join(hot, "fp", "left_anti").join(found.select("fp", "component_id"), "fp", "left")
    return prints.join(hot, "fp").unionByName(usual)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prints = saved(docs.select("doc_id", fingerprint_udf()("text").alias("fp")), "fingerprints")
    found = saved(groups(prints), "components")
    return with_component(prints, found).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
