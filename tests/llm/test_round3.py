"""Conversation repair, lexical search and mixing against brute force."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor, log

import numpy as np
import pytest

from tickloom.llm import conversations, lexical, mixing

SMALL = "/root/testdata/sf0.01"
TALK = "conv_id long, turn long, role string, text string, audit string, dropped string"


# ---- conversations ----


def brute_edits(rows):
    """The best (cost, audit) of rows (fault, initial), by trying all edits with up to len + 3 insertions, without states."""
    best = None
    n = len(rows)

    def tries(at, inserted, cost, audit, initials):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if at == n and re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best):
            best = cost, audit
        if inserted < n + 3:
            for x in "ua":
                tries(at, inserted + 1, cost + 5, audit + "I", initials + x)
        if at < n:
            fault, initial = rows[at]
            tries(at + 1, inserted, cost + 2, audit + "D", initials)
            if fault not in (conversations.BLANK, conversations.DUPLICATE):
                more = 5 * (fault == conversations.CUT)
                tries(at + 1, inserted, cost + more, audit + "K", initials + initial)
                for x in "ua":
                    tries(at + 1, inserted, cost + 1 + more, audit + "R", initials + x)

    best = (2 * n, "D" * n)
    tries(0, 0, 0, "", "")
    return best


@pytest.mark.parametrize("n", range(5))
def test_search_by_brute_force(n):
    kinds = list(itertools.product((conversations.NONE, conversations.BLANK, conversations.CUT), "suat"))
    rng = np.random.default_rng(n)
    cases = itertools.product(kinds, repeat=n) if n < 3 else [[kinds[k] for k in rng.integers(0, len(kinds), n)] for _ in range(150)]
    for rows in map(list, cases):
        assert conversations.search(rows, 0, conversations.ENDS)[:2] == brute_edits(rows)


def plain(rows):
    """What op11 should give for the rows (turn, role, text) of a conversation, by the definition, with a table over states for the edits."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults, own = set(), Counter(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        own.append((fault, role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    # cheapest edits: every prefix of rows with every pattern state, insertions applied until nothing changes
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def grown(states):
        changed = True
        while changed:
            changed = False
            for s, (cost, audit, out) in list(states.items()):
                for x in "ua":
                    if x in step[s]:
                        new = (cost + 5, audit + "I", (*out, ("user" if x == "u" else "assistant", "")))
                        if step[s][x] not in states or new[:2] < states[step[s][x]][:2]:
                            states[step[s][x]] = new
                            changed = True
        return states

    states = grown({"": (0, "", ())})
    for fault, role, text in own:
        new = {}
        for s, (cost, audit, out) in states.items():
            ways = [(s, (cost + 2, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role[:1] in step[s]:
                    ways.append((step[s][role[:1]], (cost + more, audit + "K", (*out, (role, text)))))
                ways += [(step[s][x], (cost + 1 + more, audit + "R", (*out, ("user" if x == "u" else "assistant", text)))) for x in "ua" if x in step[s]]
            for to, way in ways:
                if to not in new or way[:2] < new[to][:2]:
                    new[to] = way
        states = grown(new)
    cost, audit, out = min((states[s] for s in ("", "a") if s in states), key=lambda x: x[:2])
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()), list(out)


def damaged(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = found[conv]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return found


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def hard_talk(n=400):
    rng = np.random.default_rng(5)
    pool = ["Yes.", "No", " ", "", None, "Why?\n", "x" * 3000 + "!", "日本 ", "a ", "Ok. \x0b"]
    roles = ["user", "assistant", "system", "tool", None, "", "User", "u"]
    rows = [(int(c) if c else None, int(t) if t < 9 else None, roles[r], pool[p]) for c, t, r, p in zip(rng.integers(0, 60, n), rng.integers(0, 10, n), rng.choice(8, n, p=[0.3, 0.3, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05]), rng.integers(0, len(pool), n))]
    rows += [(900, k, ("user", "assistant")[k % 2], f"row {k // 3}" + "." * (k % 5 > 0)) for k in range(700)]
    return rows + rows[:10]


def test_repair_of_hard_rows(spark, tmp_path, monkeypatch):
    rows = hard_talk()
    spark.createDataFrame([(*r, "clash", "clash") for r in rows], TALK).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r[c] for c in NAMES) for r in conversations.op11(spark, str(tmp_path)).collect()}
    want = damaged(rows)
    assert set(got) == set(want)
    for conv, own in want.items():
        assert got[conv] == plain(own)[0], conv


def test_segments_are_as_good_as_the_whole(monkeypatch):
    rng = np.random.default_rng(2)
    for _ in range(60):
        rows = [(int(f), "suat"[i], "suat"[i] + "x", f"t{k}") for k, (f, i) in enumerate(zip(rng.choice([0, 0, 0, 1, 3], 30), rng.integers(0, 4, 30)))]
        results = []
        for size in (1, 3, 7, 1000):
            monkeypatch.setattr(conversations, "SEGMENT", size)
            held = conversations.Conversation(1)
            for k, (fault, _, role, text) in enumerate(rows):
                held.add(k, role, text, fault)
            results.append(held.result())
        assert len(set(results)) == 1


def test_op11_on_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in NAMES) for r in conversations.op11(spark, SMALL).collect()}
    assert got == {conv: plain(own)[0] for conv, own in damaged(rows).items()}


def test_messages_have_the_digest(spark):
    rows = conversations.damaged(spark.createDataFrame([(*r, None, None) for r in hard_talk(150)], TALK))
    plans = conversations.repair(rows)
    said = defaultdict(list)
    for r in conversations.messages(rows, plans).orderBy("place").collect():
        said[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for p in plans.collect():
        assert hashlib.sha256("\n".join(said[p["conv_id"]]).encode()).hexdigest() == p["repaired_sha256"], p


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], TALK).write.parquet(f"{tmp_path}/conversations.parquet")
    assert conversations.op11(spark, str(tmp_path)).count() == 0


# ---- lexical search ----


def brute_search(docs, items):
    term = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().lower())
    own = [(i, Counter(term(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in own]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(w for _, c in own for w in c)
    out = []
    for item, text in items:
        scored = []
        for (i, c), length in zip(own, lengths):
            m = 100 - 50 + (50 * length * n) // total if length else 1
            s = sum(floor(1000 * log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(term(text)) if c[w])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:50])]
    return sorted(out, key=repr)


def lexical_tables(spark, d):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(150).collect()]
    docs += [(2000 + k, docs[3][1]) for k in range(70)] + [(3000, None), (3001, ""), (3002, " ,.;"), (None, docs[5][1]), (None, docs[5][1]), (3003, "ALPHA beta-Beta é日本 x1 " * 30000), docs[7], (3004, "alpha")]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").limit(8).collect()]
    items += [(100, docs[3][1]), (101, None), (102, "..."), (103, "Beta É日本 nothingelse"), (104, "alpha ALPHA"), (None, docs[9][1][:80])]
    spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, item_id string, score long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, doc_id string").write.parquet(f"{d}/benchmark.parquet")
    return docs, items


@pytest.mark.parametrize("blocks", [1, 4])
def test_op12_by_brute_force(spark, tmp_path, monkeypatch, blocks):
    docs, items = lexical_tables(spark, str(tmp_path))
    if blocks > 1:
        monkeypatch.setattr(lexical, "BLOCK", 4)
    got = sorted((tuple(r) for r in lexical.op12(spark, str(tmp_path)).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert got == brute_search(docs, items)


def test_bounds_are_above_scores_whatever_collides():
    rng = np.random.default_rng(1)
    found = lexical.Index(None, 40, 4000)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 100) % 500) for _ in range(40)]
    from tickloom.llm.common import Lookup, utf8
    import pyarrow as pa

    data, offsets = utf8(pa.array(texts, pa.large_string()))
    item, h, _, _ = lexical.terms_of(*utf8(pa.array(["w1 w2 w3 w77 w400", "w5 w6 w1"], pa.large_string())))
    keys, at = np.unique(h, return_inverse=True)
    order = np.argsort(at, kind="stable")
    weight = rng.integers(100, 9000, len(keys))
    first = np.append(np.searchsorted(at[order], np.arange(len(keys))), len(at))
    for shift in (62, 60, 48):  # 4, 16 and all coordinates
        place = (keys >> np.uint64(shift)).astype(np.int64)[at] * 2 + item
        both, inverse = np.unique(place, return_inverse=True)
        coordinate, c_first = np.unique(both // 2, return_index=True)
        block = lexical.Block(keys, first, item[order], weight, coordinate, np.append(c_first, len(both)), both % 2, np.bincount(inverse, weight[at], len(both)), 2)
        exact = lexical.scores(found, block, Lookup(keys), data, offsets)
        doc, hashes, tf, size = lexical.terms_of(data, offsets)
        sketches = []
        for d in range(40):
            cell = {}
            for x, f in zip((hashes[doc == d] >> np.uint64(shift)).tolist(), tf[doc == d].tolist()):
                cell[x] = max(cell.get(x, 0), f)
            sketches.append((np.array(sorted(cell), "<u2").tobytes(), np.array([cell[x] for x in sorted(cell)], "<u2").tobytes()))
        upper = lexical.bounds(found, block, size, [a for a, _ in sketches], [b for _, b in sketches])
        assert (upper >= exact).all() and exact.max() > 0
        if shift == 48:
            assert (upper == exact).mean() > 0.9


def test_terms_of_a_long_text_go_in_parts(monkeypatch):
    import pyarrow as pa

    from tickloom.llm.common import utf8

    column = utf8(pa.array(["Ab, ab x-9 É日 " * 500 + "z" * 90], pa.large_string()))
    whole = lexical.terms_of(*column)
    monkeypatch.setattr(lexical, "PART", 32)
    parts = lexical.terms_of(*column)
    assert all((a == b).all() for a, b in zip(whole, parts)) and whole[3].tolist() == [2501]


def test_search_in_empty_tables(spark, tmp_path):
    lexical_tables(spark, str(tmp_path / "a"))
    for t, other in (("documents", "benchmark"), ("benchmark", "documents")):
        d = str(tmp_path / f"no-{t}")
        spark.read.parquet(f"{tmp_path}/a/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
        spark.read.parquet(f"{tmp_path}/a/{other}.parquet").write.parquet(f"{d}/{other}.parquet")
        assert lexical.op12(spark, d).count() == 0


# ---- mixing ----


def brute_targets(sizes):
    """Targets by resharing again and again, in fractions."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, limit = sum(sizes.values()), {s: 3 * n for s, n in sizes.items()}
    target = {s: Fraction(total * weight[s], sum(weight.values())) for s in order}
    while above := [s for s in order if target[s] > limit[s]]:
        excess = sum(target[s] - limit[s] for s in above)
        for s in above:
            target[s] = Fraction(limit[s])
        free = [s for s in order if target[s] < limit[s]]
        for s in free:
            target[s] += excess * weight[s] / sum(weight[x] for x in free)
    return target


def mix_docs(seed=4, sources=9):
    rng = np.random.default_rng(seed)
    names = [None, "", "b", "B", "é", "日本", "z1", "zero", "𝒳"][:sources]
    return [(int(i), " ".join(["w"] * int(n)) if names[s] != "zero" else (None, " \t")[i % 2], names[s]) for i, (n, s) in enumerate(zip(rng.integers(0, 60, 3000), rng.choice(len(names), 3000, p=np.array([9, 1, 200, 30, 1, 5, 5, 2, 3][:sources]) / sum([9, 1, 200, 30, 1, 5, 5, 2, 3][:sources]))))]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, size int, target double").repartition(5)


@pytest.mark.parametrize("broadcast", [True, False])
def test_mix_by_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:  # hot sources by broadcast, others by a join; sources ranked in ranges of two
        for name, value in (("MOST_BROADCAST", 0), ("HOT", 10), ("RANGE", 2)):
            monkeypatch.setattr(mixing, name, value)
    rows = mix_docs()
    mixed = mixing.mix(frame(spark, rows))
    got = mixed.select("row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    target = brute_targets(sizes)
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    words = {i: len((t or "").split()) for i, t, _ in rows}
    taken = Counter()
    for r in got:
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == sizes[r["source"]] and abs(r["target"] - float(target[r["source"]])) < 1e-6
        rate = target[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        assert floor(rate) <= r["copies"] <= min(3, floor(rate) + 1) and (sizes[r["source"]] or r["copies"] == 0)
        taken[r["source"]] += r["size"] * r["copies"]
    for source in ("b", "B"):
        assert abs(taken[source] / float(target[source]) - 1) < 0.1
    again = mixing.mix(frame(spark, rows[::-1]).repartition(2))
    key = lambda r: (r["doc_id"], r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again.select("row.doc_id", "copies").collect()))
    emitted = mixing.emit(mixed)
    assert emitted.columns == ["doc_id", "text", "source", "size", "target"]
    assert Counter(r["doc_id"] for r in emitted.select("doc_id").collect()) == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})


@pytest.mark.parametrize("seed", range(3))
def test_targets_of_uneven_sources(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {f"s{k}": int(n) for k, n in enumerate(rng.zipf(1.3, 40) % 5000)}
    docs = spark.createDataFrame([(k, "w " * n, s) for k, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
    got = {r["source"]: r["target"] for r in mixing.plan(docs).collect()}
    assert all(abs(got[s] - float(t)) < 1e-6 * max(1, float(t)) for s, t in brute_targets(sizes).items())


def test_mix_of_nothing(spark, tmp_path):
    frame(spark, [(1, "a", "b")]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert mixing.op13(spark, str(tmp_path)).count() == 0
    none = frame(spark, [(1, None, "a"), (2, "", None), (2, "", None), (None, " ", "a")])
    assert [(r["size"], r["target"], r["copies"]) for r in mixing.mix(none).collect()] == [(0, 0.0, 0)] * 4


def test_no_python_in_the_mix(spark):
    plan = mixing.op13(spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("module, op", [(lexical, lexical.op12), (mixing, mixing.op13)], ids=["op12", "op13"])
def test_sql(spark, module, op):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = op(spark, SMALL)
    found = con.execute(module.SQL)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(found.fetchall(), key=repr) == sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)


# ---- hot ids ----


def test_shards_of_null_and_repeated_ids(spark, monkeypatch, tmp_path):
    """Nine tenths null or one id: no shard is over twice the middle one, and the files are right."""
    from tickloom.llm import common, token_files

    monkeypatch.setattr(common, "RANGE_BYTES", 8000)
    rng = np.random.default_rng(6)
    text = lambda: " ".join(f"w{k}" for k in rng.integers(0, 300, rng.integers(15, 25)))
    for ids in ([None] * 1350 + list(range(150)), [7] * 1350 + list(range(150)), [5] * 1500):
        rows = [(i, text()) for i in ids]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        out = str(tmp_path / f"out-{len(list(tmp_path.iterdir()))}")
        token_files.write_files(docs, out, token_files.tokenizer_path("word_bpe_49k.json"))
        blocks = spark.read.parquet(f"{out}/blocks").collect()
        sizes = Counter()
        for b in blocks:
            sizes[b["shard"]] += len(b["doc_ids"])
        assert len(sizes) > 8 and max(sizes.values()) <= 2 * np.median(list(sizes.values()))
        got = sorted(token_files.read_files(spark, out).collect(), key=lambda r: r["start"])
        assert [r["start"] for r in got] == list(np.cumsum([0] + [r["n_tokens"] for r in got[:-1]]))
        assert [-1 if r["doc_id"] is None else r["doc_id"] for r in got] == sorted(-1 if i is None else i for i in ids)


@pytest.mark.parametrize("name", ["url_rules", "lm_base", "text_edits"])
def test_parts_by_sql(spark, name):
    import duckdb

    from tickloom.llm import checks

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    got = checks.QUERIES[name](spark, "/root/testdata/sf0.001")
    found = con.execute(checks.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(found.fetchall(), key=repr) == sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)


# ---- more of the earlier operators against brute force ----


def plain_toxic_features(text):
    """Words and their beginnings of 4 to 6 bytes, with marks of what they are."""
    low = text.lower().encode()
    words = re.split(rb"[\x00-\x08]{0}[ \t\n\x0b\x0c\r!-/:-@\[-`{-~]+", low)
    out = set()
    for w in filter(None, words):
        out.add((0, w))
        out |= {(k, w[:k]) for k in (4, 5, 6) if len(w) > k}
    return out


def toxic_hash(feature):
    from tickloom.llm import toxicity

    kind, w = feature
    word = w if kind == 0 else w + b"x"
    data = np.frombuffer(word, np.uint8)
    hashes, _ = toxicity.features(data, np.array([0, len(word)]))
    return int(hashes[0 if kind == 0 else 1 + [k for k in (4, 5, 6) if len(word) > k].index(kind)])


def test_toxicity_by_brute_force(spark):
    from tickloom.llm import toxicity

    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.withColumn("text", labels["doc_id"].cast("string")))  # a clashing column
    toxic = {r["doc_id"]: bool(r["toxic"]) for r in labels.collect()}
    texts = {(r["text"], toxic[r["doc_id"]]) for r in docs.collect() if r["doc_id"] in toxic and r["text"] is not None}
    bad, good = sum(t for _, t in texts), sum(not t for _, t in texts)
    assert bad and good and len(texts) <= 2 * toxicity.MAX_PER_CLASS
    t, c = Counter(), Counter()
    for text, is_bad in texts:
        (t if is_bad else c).update(plain_toxic_features(text))
    scored = []
    for f in t:
        share = (t[f] + c[f]) / (bad + good)
        if t[f] >= toxicity.LEAST_TEXTS and share < 1:
            z = (t[f] / bad - c[f] / good) / (share * (1 - share) * (1 / bad + 1 / good)) ** 0.5
            if z >= toxicity.LEAST_Z:
                scored.append((z, f))
    assert len(scored) <= toxicity.MAX_FEATURES
    chosen = {f for z, f in scored if z >= toxicity.LEAST_PART * max(scored)[0]}
    by_hash = {toxic_hash(f): f for f in chosen}
    assert sorted(by_hash) == sorted(int(k) for k in model.keys)
    weight = {by_hash[int(k)]: w for k, w in zip(model.keys, model.weights)}
    got = {r["doc_id"]: r for r in docs.select("doc_id", toxicity.scorer(spark, model)("text").alias("s")).select("doc_id", "s.*").collect()}
    for r in docs.collect():
        score = sum(weight[f] for f in plain_toxic_features(r["text"] or "") & weight.keys())
        above = [1 / (1 + np.exp(-(score - x))) for x in model.thresholds]
        own = got[r["doc_id"]]
        assert own["severity"] == pytest.approx(sum(above), abs=1e-9) and own["toxic"] == (above[0] >= toxicity.THRESHOLD) and own["grade"] == sum(x >= toxicity.THRESHOLD for x in above)


def test_grades_rise_with_evidence(spark):
    """Of documents with more of the words that speak for toxicity the expected severity is never lower."""
    from tickloom.llm import toxicity

    model = toxicity.fit(*(spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels")))
    assert (np.diff(model.thresholds) > 0).all()
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select(toxicity.scorer(spark, model)("text").alias("s")).select("s.*").orderBy("severity").collect()
    assert all(a["grade"] <= b["grade"] and a["toxic"] <= b["toxic"] for a, b in zip(rows, rows[1:]))


def test_fingerprints_of_null_ids_and_repeated_rows(spark, tmp_path):
    from tickloom.llm import simhash

    rows = [(None, "a b c d e", "x"), (None, "a b c d e", "x"), (None, "", "x"), (7, None, "x"), (7, "a b c d e", "x"), (3, "a b c d e", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.op6(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(None, 3), (None, 3), (None, 7), (7, 7), (7, 3), (3, 3)], key=repr)


def test_edits_of_equal_and_null_ids(spark, tmp_path):
    """Rows of one id follow each other, and each has a text of the id or the one after as its next."""
    from tickloom.llm import phrase_print

    rows = [(5, f"text number {k} " * (k + 1)) for k in range(40)] + [(2, "the text below, which is longer than others are"), (None, "none of these")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = phrase_print.op3(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((i, len(t)) for i, t in rows)
    texts = [t for i, t in rows if i is not None]
    for r in got:
        if r["doc_id"] == 5:
            own = [t for t in texts if len(t) == r["n_chars"]]
            assert any(hashlib.sha256(phrase_print.edited(t, f).encode()).hexdigest() == r["edited_sha256"] for t in own for f in texts)


def test_hot_words_get_their_counts(spark, monkeypatch):
    from tickloom.llm import lm_score

    rng = np.random.default_rng(2)
    for hot in (1000, 5):
        monkeypatch.setattr(lm_score, "HOT", hot)
        tail = [(int(r), 7 if k % 3 else int(h)) for k, (r, h) in enumerate(zip(rng.integers(0, 50, 900), rng.integers(0, 40, 900)))]
        counts = {h: h * 10 for h in range(0, 40, 2)} | ({7: 70} if hot == 5 else {})
        got = lm_score.with_counts(spark.createDataFrame(tail, "row long, h long"), spark.createDataFrame(list(counts.items()), "h long, n long"), len(tail)).collect()
        assert Counter((r["row"], r["h"], r["n"]) for r in got) == Counter((r, h, counts.get(h)) for r, h in tail)
