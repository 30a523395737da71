"""Bounded memory: long texts go in parts, groups of long texts in blocks, with the results of the whole."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa

from tickloom.llm import decontaminate, near_copies
from tickloom.llm.common import utf8

ROOT = Path(__file__).resolve().parents[2]


def test_parts_of_a_long_text_hold_all_its_halves():
    words = [f"w{k}" for k in range(3001)]
    text = "  " + " ".join(words) + "..."
    data, offsets = utf8(pa.array(["short one", text, "last"]))
    overlap = 2 * decontaminate.HALF
    parts = list(decontaminate.parts_of(data, offsets, overlap, most=900))
    raw = [[p.low.tobytes()[a:b].decode() for a, b in zip(p.start, p.end)] for _, p in parts]
    assert raw[0] == ["short", "one"] and raw[-1] == ["last"]
    long = [r for r, (i, _) in zip(raw, parts) if i == 1]
    assert len(long) > 3 and all(int(r[0][1:]) % decontaminate.HALF == 0 for r in long)
    assert all(int(b[0][1:]) == int(a[-1][1:]) + 1 - overlap for a, b in zip(long, long[1:])) and long[-1][-1] == "w3000"
    # one word without an end is one part
    data, offsets = utf8(pa.array(["x" * 5000]))
    assert [len(p) for _, p in decontaminate.parts_of(data, offsets, overlap, most=100)] == [1]


def test_blocks_of_sets_by_brute_force(monkeypatch):
    monkeypatch.setattr(near_copies, "COLUMNS", 7)
    rng = np.random.default_rng(3)
    sets = [rng.choice(40, rng.integers(1, 12), replace=False).astype(np.int32) for _ in range(30)]
    sets += [np.append(s, np.int32(50 + k)) for k, s in enumerate(sets[:10])]
    n = len(sets)
    got = near_copies.block_links(pa.table({"sid": np.arange(n), "root": np.arange(n), "block": (np.arange(n) >= 30).astype(np.int32), "members": pa.array(sets, pa.list_(pa.int32()))}))

    def groups(pairs):
        at = list(range(n))
        for a, b in pairs:
            at = [at[a] if x == at[b] else x for x in at]
        return {frozenset(np.flatnonzero(np.array(at) == x).tolist()) for x in at}

    def close(a, b):
        both = len(set(sets[a].tolist()) & set(sets[b].tolist()))
        return 5 * both >= 4 * (len(set(sets[a].tolist()) | set(sets[b].tolist())))

    want = [(a, b) for a in range(n) for b in range(n) if a < 30 <= b and close(a, b)]
    assert want and groups(want) == groups(zip(got["a"].to_pylist(), got["b"].to_pylist()))


PEAK = """
import resource, sys
sys.path.insert(0, {root!r})
import numpy as np, pyarrow as pa
from tickloom.llm import decontaminate as d, near_copies as nc
from tickloom.llm.common import Lookup
rng = np.random.default_rng(0)
if {which!r} == "near":
    base = rng.integers(0, 2**31, 10_000).astype(np.int32)
    sets = [np.concatenate([base, rng.integers(0, 2**31, 10_000).astype(np.int32)]) for _ in range(192)]
    nc.block_links(pa.table({{"sid": np.arange(192), "root": np.arange(192), "block": np.repeat([0, 1], 96).astype(np.int32), "members": pa.array(sets, pa.list_(pa.int32()))}}))
else:
    words = ["word%d" % k for k in range(40)]
    items = d.read_items([(1, " ".join(words) + ". The answer is here.")])
    keys = np.unique(np.array([w for ws in items.words for w in ws], np.uint64))
    latent = rng.normal(size=(len(keys), 128)).astype(np.float32)
    index = d.Index(items, keys, np.ones(len(keys), np.float32), latent, latent[Lookup(keys).find(items.passage_words()[0])].sum(0, keepdims=True), np.zeros(1, np.int64), 128)
    block = d.Block([index], keys, [np.arange(len(keys))])
    line = " ".join(words[k] for k in rng.integers(0, 40, 1000)) + " "
    text = line * (64_000_000 // len(line)) + " ".join(words) + ". The answer is here."
    found = d.matches(block, Lookup(keys), pa.array([text], pa.large_string()))
    assert [m[1] for m in found] == [1] and found[0][3] == 1
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def peak_mb(which):
    done = subprocess.run([sys.executable, "-c", PEAK.format(root=str(ROOT), which=which)], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    return int(done.stdout)


def test_a_group_of_long_texts_takes_bounded_memory():
    assert peak_mb("near") < 500


def test_a_text_of_64_mb_takes_bounded_memory():
    assert peak_mb("text") < 500
