"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import bpe, decontaminate, language, length_hist, lm_score, near_copies, phrase_print, simhash, token_files, toxicity, url_filter
from tickloom.llm.common import Lookup, Words, utf8

TINY = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, score string"
LONG = "lorem ipsum dolor sit amet " * 4000


def texts(spark, n=120):
    rows = spark.read.parquet(f"{TINY}/documents.parquet").orderBy("doc_id").limit(n).collect()
    return [(r["doc_id"], r["text"], r["lang"]) for r in rows]


def documents(spark, n=120, extra=True):
    rows = [(i, t, lang, "s", len(t), "clash", "clash") for i, t, lang in texts(spark, n)]
    if extra:
        rows += [
            (1000, None, None, None, None, None, None), (1001, "", "en", None, 0, None, None), (1002, "  \t\n", None, "s", 4, None, None), (1003, LONG, "en", "s", len(LONG), None, None),
            (1004, "one two", "en", "s", 7, None, None), (1005, rows[0][1], "en", "s", 1, None, None), rows[0], (None, "no id here at all", "en", "s", 1, None, None), (1006, "日本語 <|endoftext|> x’s it's  \n\n", "ja", "s", 1, None, None),
            (1007, "x" * 5000 + "é" * 3000, None, "s", 1, None, None), (1008, "12 34 !!", "en", "s", 8, None, None),
        ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def table_dir(spark, tmp_path_factory):
    """A folder of tables with edge cases."""
    d = str(tmp_path_factory.mktemp("tables"))
    documents(spark).write.parquet(f"{d}/documents.parquet")
    for t in ("labels", "benchmark", "pages"):
        spark.read.parquet(f"{TINY}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{TINY}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


def rows_of(spark, d):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]


def words_of(text):
    return text.encode().lower().split()


def test_words_and_lookup():
    column = pa.array(["Ab c", None, "", " \x0bÉa\u00a0b\r", "zz"])
    words = Words(*utf8(column))
    raw = words.low.tobytes()
    assert [raw[a:b] for a, b in zip(words.start, words.end)] == b"ab c".split() + "Éa\u00a0b".encode().split() + [b"zz"]
    assert words.first.tolist() == [0, 2, 2, 2, 3, 4]
    same = Words(*utf8(pa.array(["x zz", "Zz zzz"]))).hashes()
    assert same[1] == same[2] and len(set(same.tolist())) == 3
    keys = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    look = Lookup(keys[:3000])
    look.add(keys[3000:4000])
    assert (look.find(keys)[:4000] == np.arange(4000)).all() and (look.find(keys)[4000:] == -1).all()


def test_op10(spark, table_dir):
    got = language.op10(spark, table_dir).collect()
    assert len(got) == len(rows_of(spark, table_dir))
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1000, 1001, 1002, 1008))
    assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 3 == 1) for r in got)
    truth = {i: lang for i, _, lang in texts(spark)}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.9
    # plain naive Bayes over the same buckets
    d = spark.read.parquet(f"{table_dir}/documents.parquet")
    model = language.fit(d.where(~language.held_out()))
    for text in ("the nd thing", "Éaux la des"):
        found, _ = language.grams(*utf8(pa.array([text])))
        logs = (model.prior + np.array([sum(row[b] for b in found.ravel()) for row in model.matrix.astype(float)])) / (1 + found.size / model.grain)
        r = spark.createDataFrame([(text,)], "text string").select(language.predictor(spark, model)("text").alias("p")).first()["p"]
        assert r["lang_pred"] == model.langs[int(np.argmax(logs))] and abs(r["score"] - 1 / np.exp(logs - logs.max()).sum()) < 1e-4


def test_language_counts(spark):
    """The matrix by brute force over the rows that are counted."""
    rows = [("the cat and the dog " * (k % 5 + 1) + str(k), "en") for k in range(60)] + [("le chat et la souris " * (k % 3 + 1) + str(k), "fr") for k in range(50)] + [(None, "fr"), ("x", None), ("", "en")]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    kept = {r["text"] for r in spark.createDataFrame(rows, "text string, lang string").where(f"pmod(xxhash64(text), {language.FOLDS}) != 0").collect()}
    assert len(kept) < len(rows) - 1
    for k, lang in enumerate(model.langs):
        counts = Counter()
        for text, own in rows:
            if own == lang and text is not None and text in kept:
                counts.update(language.grams(*utf8(pa.array([text])))[0].ravel().tolist())
        total = sum(counts.values()) + language.SMOOTHING * (1 << language.BUCKET_BITS)
        want = np.log((np.array([counts[b] for b in range(1 << language.BUCKET_BITS)]) + language.SMOOTHING) / total)
        assert np.allclose(model.matrix[k], want, atol=1e-4)


def test_many_languages(spark):
    """All of 300 languages are learned and told apart."""
    rng = np.random.default_rng(1)
    words = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 4))) for _ in range(300)]
    rows = [(f"{w} " * 5 + str(j), f"l{k:03d}") for k, w in enumerate(words) for j in range(4)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = docs.select("lang", language.identify(docs, language.fit(docs)).alias("p")).collect()
    assert len({r["p"]["lang_pred"] for r in got}) == 300 and np.mean([r["lang"] == r["p"]["lang_pred"] for r in got]) > 0.98


def test_op8(spark, table_dir):
    assert len(toxicity.op8(spark, table_dir).collect()) == len(rows_of(spark, table_dir))
    # planted words in made-up labels
    docs = [(i, f"plain words number {i} of text {'grobian schuft' if i % 3 == 0 else ''} {'lump' if i % 6 == 0 else ''}") for i in range(240)]
    docs = spark.createDataFrame([*docs, (None, "schuft grobian"), (990, None), (991, "a GROBIAN: SCHUFT, here")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)] + [(5, 1, None), (None, 0, 1), (500, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", toxicity.scorer(spark, model)("text").alias("s")).collect()}
    assert all(got[i]["toxic"] == (i % 3 == 0) for i in range(240)) and got[991]["toxic"] and got[None]["toxic"] and not got[990]["toxic"]
    assert got[6]["severity"] > got[1]["severity"] and 0 <= got[1]["severity"] <= toxicity.GRADES - 1
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert docs.select(toxicity.scorer(spark, none)("text").alias("s")).where("s.toxic or s.severity > 0").count() == 0


def test_ordinal_gradient():
    rng = np.random.default_rng(1)
    x = rng.random((400, 3)) < 0.4
    score = x @ np.array([3.0, 1.5, 0]) + rng.logistic(size=400)
    grade = np.searchsorted([1.5, 3, 5], score)
    w, cuts = toxicity.fit_ordinal(*np.nonzero(x), grade, 3)
    assert w[0] > w[1] > w[2] + 0.3 and (np.diff(cuts) > 0).all() and abs(w[2]) < 0.6


def plain_print(text, k=3):
    w = words_of(text)
    k = min(k, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, distance=2):
    prints = [plain_print(t) for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= distance and group[j] < group[i]:
                    group[i], changed = group[j], True
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in set(group)}
    return prints, [least[g] for g in group]


def test_op6(spark, table_dir):
    rows = rows_of(spark, table_dir)
    prints, least = plain_components(rows)
    want = Counter((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, least))
    assert Counter(tuple(r) for r in simhash.op6(spark, table_dir).select("doc_id", "fingerprint", "component_id").collect()) == want


def test_vantage_points_find_all_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 1500).astype(np.uint64)
    near = base[rng.integers(0, 1500, 1500)] ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64))
    dense = np.arange(1200, dtype=np.uint64)  # a cluster that no ball divides well
    values = np.unique(np.concatenate([base, near, dense]))
    pairs = np.argwhere(np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= 2, 1))
    tree = simhash.Tree(values[::3], 4, 2)
    at, leaf = tree.deal(values)
    together = {}
    for a, b in zip(at.tolist(), leaf.tolist()):
        together.setdefault(a, set()).add(b)
    assert all(together[i] & together[j] for i, j in pairs.tolist()) and len(set(leaf.tolist())) > 4
    root = {int(v): int(v) for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in simhash.near_pairs(values, 2, np.random.default_rng(0)):
        assert (b < a).all()
        for x, y in zip(a.tolist(), b.tolist()):
            root[find(x)] = find(y)
    assert all(find(int(values[i])) == find(int(values[j])) for i, j in pairs.tolist())


def plain_near_groups(rows):
    """The group of each of rows (id, text): the least position that chains of pairs of similarity 0.8 or more reach."""

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if group[i] != group[j] and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    return group


def test_near_copies(spark):
    """Of pairs with a five-word Jaccard similarity of 0.8 or more one stays, by brute force; null ids and repeated ids group by the texts alone."""
    rng = np.random.default_rng(9)
    fill = [f"w{k}" for k in range(3000)]
    rows = []
    for k in range(60):
        base = rng.choice(fill, 200).tolist()
        for c in range(3):
            own = list(base)
            for at in rng.choice(200, c * (k % 6), replace=False):
                own[at] = "new" + str(rng.integers(1 << 30))
            rows.append((3 * k + c, " ".join(own)))
    cluster = rng.choice(fill, 200).tolist()
    rows += [(1000 + k, " ".join([*cluster[:k], "other" + str(k), *cluster[k + 1 :]])) for k in range(150)]
    rows += [(5, "an id again, on quite another text"), (5, "and again on one more unlike any"), (None, " ".join(cluster)), (None, None), (None, " "), (9000, "")]

    group = plain_near_groups(rows)
    want = Counter(min((r[0] for r, g in zip(rows, group) if g == x and r[0] is not None), default=None) for x in set(group))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(r["doc_id"] for r in near_copies.keep_one_of_each(docs).collect()) == want


def test_near_copies_of_a_hot_group(spark):
    """Many texts that share most fingerprints, in chains that only whole comparisons of the group link."""
    rng = np.random.default_rng(2)
    shared = [f"s{k}" for k in range(300)]
    rows = []
    for k in range(130):  # couples: each of them is alike, two couples are not
        own = [f"o{k}x{j}" for j in range(90)]
        rows += [(2 * k, " ".join(shared + own)), (2 * k + 1, " ".join(shared + own[:-8] + [f"z{k}y{j}" for j in range(8)]))]
    order = rng.permutation(len(rows))
    docs = spark.createDataFrame([rows[k] for k in order], "doc_id long, text string").repartition(4)
    assert sorted(r["doc_id"] for r in near_copies.keep_one_of_each(docs).collect()) == [2 * k for k in range(130)]


def test_large_leaves_are_dealt_again(spark):
    """Links of few large leaves are those of a plain search, dense clusters in blocks of pairs among them."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 900).astype(np.uint64)
    near = base[:400] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    values = np.unique(np.concatenate([base, near, np.arange(700, dtype=np.uint64)]))
    prints = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    got = {r["v"]: r["root"] for r in simhash.components(simhash.link(prints, 2, most=200)).collect()}
    want = {r["v"]: r["root"] for r in simhash.components(simhash.link(prints, 2)).collect()}
    label = values.view(np.int64).copy()
    close = np.argwhere(np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= 2, 1))
    while True:
        old = label.copy()
        np.minimum.at(label, close[:, 0], label[close[:, 1]])
        np.minimum.at(label, close[:, 1], label[close[:, 0]])
        if (old == label).all():
            break
    ends = set(close.ravel().tolist())
    assert got == want == {int(values.view(np.int64)[k]): int(label[k]) for k in ends}


def test_components(spark):
    edges = [(i, i + 1) for i in range(60) if i % 20 != 19] + [(100, i) for i in range(101, 130)] + [(129, 5), (7, 7)]
    got = {r["v"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: 0 if v < 20 or v >= 100 else v // 20 * 20 for e in edges if e[0] != e[1] for v in e}


def test_op3(spark, table_dir):
    rows = sorted(((i, t) for i, t in rows_of(spark, table_dir) if i is not None), key=lambda r: (-r[0], r[1]))
    want = Counter()
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        want[i, len(t), hashlib.sha256(phrase_print.edited(t, n).encode()).hexdigest()] += 1
    got = phrase_print.op3(spark, table_dir).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got if r["doc_id"] is not None) == want and len(got) == len(rows) + 1
    of = {}
    for r, t in ((r, dict(rows).get(r["doc_id"])) for r in got if r["doc_id"] is not None):
        assert of.setdefault(t, r["fingerprint"]) == r["fingerprint"] and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    long = [r for r in got if r["n_chars"] > 400]
    assert np.mean([r["near_edited"] for r in long]) > 0.35 > np.mean([r["near_next"] for r in long]) + 0.2


def test_phrases_are_local():
    rng = np.random.default_rng(4)
    shared = "".join(rng.choice(list("abcdefgh "), 3000))
    a, b = ("".join(rng.choice(list("ijklmnop "), n)) for n in (137, 911))
    names = []
    for text in (a + shared, b + shared, shared):
        symbols, first = utf8(pa.array([text]))
        for _ in range(3):
            symbols, first = phrase_print.next_level(symbols, first)
        names.append(set(symbols.tolist()))
    assert len(names[0] & names[1] & names[2]) > 0.9 * len(names[2])
    assert (phrase_print._marks(["aaaa" * 50, "abc"]) == phrase_print._marks(["abc", "aaaa" * 50])[::-1]).all()


def test_op4(spark, table_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_files.tokenizer_path("word_bpe_49k.json"))
    got = token_files.op4(spark, table_dir).collect()
    rows = rows_of(spark, table_dir)
    ids = [[*library.encode(t, add_special_tokens=False).ids, 1] for _, t in rows]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((r[0], len(x), crc(x)) for r, x in zip(rows, ids))
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == list(np.cumsum([0] + [r["n_tokens"] for r in ordered[:-1]]))
    assert [r["doc_id"] if r["doc_id"] is not None else -1 for r in ordered] == sorted(r[0] if r[0] is not None else -1 for r in rows)


def test_files_are_read_without_their_writer(spark, table_dir, tmp_path):
    docs = spark.read.parquet(f"{table_dir}/documents.parquet")
    token_files.write_files(docs, str(tmp_path / "out"), token_files.tokenizer_path("word_bpe_49k.json"))
    got = token_files.read_files(spark.newSession(), str(tmp_path / "out"), of=lambda ids: ids.tolist(), of_type="array<long>", name="ids").collect()
    encode = token_files.WordEncoder(token_files.tokenizer_path("word_bpe_49k.json")).tokenizer.encode
    want = Counter((r["doc_id"], tuple(encode(r["text"] or "", add_special_tokens=False).ids) + (1,)) for r in docs.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_coding(bits):
    for n in range(0, 40):
        v = np.random.default_rng(n).integers(0, 1 << bits, n)
        control, data = token_files.pack(v)
        assert (token_files.unpack(control, data)[:n] == v).all() and len(control) == -(-n // 4)


def test_word_encoder_forgets(monkeypatch):
    monkeypatch.setattr(token_files, "MAX_WORDS", 6)
    path = token_files.tokenizer_path("word_bpe_49k.json")
    own = token_files.WordEncoder(path)
    for text in ("a b c", "d e f, g.", "a b x y z, foo's (bar) d", "İ ß Σ..."):
        ids, first = own.encode(*utf8(pa.array([text])))
        assert ids.tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids and first[-1] == len(ids)


def test_op9_and_op7(spark, table_dir):
    from tokenizers import Tokenizer

    path = token_files.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = rows_of(spark, table_dir)
    ids = [library.encode(t, add_special_tokens=False).ids for _, t in rows]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter((r[0], len(x), sha(",".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for r, x in zip(rows, ids))
    assert Counter(tuple(r) for r in bpe.op9(spark, table_dir).collect()) == want
    d = spark.read.parquet(f"{table_dir}/documents.parquet").select("text", bpe.encode_udf(path)("text").alias("ids"))
    assert all(r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids and r["back"] == (r["text"] or "") for r in d.withColumn("back", bpe.decode_udf(path)("ids")).collect())
    n = np.array([len(x) for x in ids])
    sums = length_hist.op7(spark, table_dir)
    for r in sums.collect():
        k = r["n_tokens"]
        assert (r["docs"], r["docs_at_least"], r["tokens_at_least"], r["tokens_kept"]) == ((n == k).sum(), (n >= k).sum(), n[n >= k].sum(), np.minimum(n, k).sum())
    assert tuple(length_hist.at_limit(sums, 100).first()) == ((n > 100).sum(), np.minimum(n, 100).sum())
    assert length_hist.quantile(sums, 0.5).first()[0] == sorted(n)[-(-len(n) // 2) - 1]


def test_tree_concatenation():
    path = token_files.tokenizer_path("byte_bpe_50k.json")
    own = bpe.Codec(path)
    rng = np.random.default_rng(8)
    for alphabet in ("ab", "etaoinshr", "=-", " \n", "0123", "日本語éa"):
        for n in (1025, 3000):
            text = "".join(rng.choice(list(alphabet), n))
            want = own.library.encode(text, add_special_tokens=False).ids
            assert own.encode_texts([text])[0].tolist() == want
            if len(set(alphabet) & set(" \n日1234567890=-")) == 0:
                assert own.encode_long(text) == want and own.merge_bytes(text.encode()) == want


def thue_morse(n):
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return [text[:n], text[:n].translate(str.maketrans("ab", "ba"))]


#: texts on which polynomial hashes, lower-casing before composition, or tables of other Unicode versions go wrong
HARD = [*thue_morse(1024), *thue_morse(4096), "H\u0331 T\u0308 W\u030a Y\u030a J\u030c \u1e96", "x" * 5000 + "\U0001f680", "\u0645" * 5000, "\u05e9\u05dc\u05d5\u05dd " * 900, "\u0e44\u0e17\u0e22" * 900, "don't, isn't. A's (B)!? \u0130\u03a3."]


def fuzzed(n):
    import random

    rng = random.Random(11)
    pool = [*"aAbB'stmdrvel .,!?0129\n\t\u3000\u00a0\u00c9\u00df\u0130\u03a3\u03c2\u1e96\u0331\u0308\u030a\u0645\u05e9\u0915\u093f\u65e5\u672c\u0301\u200d\ufeff\x0b\x1c_-#", "\U0001d400", "\U0001f680", "'s", "'ll", "<|endoftext|>", "  "]
    for _ in range(n):
        yield "".join(rng.choice(pool) for _ in range(rng.randint(0, 24))) + (chr(rng.randrange(0xE000, 0x110000)) if rng.random() < 0.1 else "")


def test_hard_texts_have_the_library_s_ids(spark):
    from tokenizers import Tokenizer

    texts = [*HARD, *fuzzed(20_000)]
    for name, own in (("byte_bpe_50k.json", bpe.Codec), ("word_bpe_49k.json", token_files.WordEncoder)):
        path = token_files.tokenizer_path(name)
        codec, library = own(path), Tokenizer.from_file(path)
        for at in range(0, len(texts), 5000):
            part = texts[at : at + 5000]
            ids, first = codec.encode_texts(part) if name.startswith("byte") else codec.encode(*utf8(pa.array(part)))
            assert all(e.ids == ids[a:b].tolist() for e, a, b in zip(library.encode_batch(part, add_special_tokens=False), first[:-1], first[1:], strict=True))
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string").coalesce(1)
    library = Tokenizer.from_file(token_files.tokenizer_path("byte_bpe_50k.json"))
    assert sorted(r["n_tokens"] for r in bpe.lengths(docs, token_files.tokenizer_path("byte_bpe_50k.json")).collect()) == sorted(len(library.encode(t, add_special_tokens=False).ids) for t in HARD)


def test_runs_in_any_script_go_by_tree_concatenation(monkeypatch):
    own, seen = bpe.Codec(token_files.tokenizer_path("byte_bpe_50k.json")), []
    plain = own.encode_long
    monkeypatch.setattr(own, "encode_long", lambda text: seen.append(text) or plain(text))
    for text in ("\u0645" * 5000, "x" * 5000 + "\U0001f680", "\u0e44" * 2000):
        ids, _ = own.encode_texts([text])
        assert ids.tolist() == own.library.encode(text, add_special_tokens=False).ids
    assert [len(x) for x in seen] == [5000, 5000, 2000]


def test_memory_compares_bytes(monkeypatch):
    """Ids are right even if all strings have one hash."""
    from tickloom.llm import common

    monkeypatch.setattr(common, "span_hash", lambda data, start, end: np.full(len(start), 7, np.uint64))
    own = token_files.WordEncoder(token_files.tokenizer_path("word_bpe_49k.json"))
    for text in ("some words, and some others", "other words at all " * 3):
        assert own.encode(*utf8(pa.array([text])))[0].tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_long_texts_are_dealt_in_parts(spark):
    """A text of over BIG characters, with runs without a cut in several scripts, and any other columns."""
    from tokenizers import Tokenizer

    path = token_files.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    text = thue_morse(1 << 16)[0] * 8 + " and <|endoftext|> then " + "\u0645" * 300_000 + " one two three" * 5_000
    docs = spark.createDataFrame([(1, text, "a"), (2, "short", "b"), (3, None, None), (1, text, "c")], "doc_id long, text string, ids_ string")
    want = library.encode(text, add_special_tokens=False).ids
    got = {(r["doc_id"], r["ids_"]): r["ids"] for r in bpe.encode(docs, path).collect()}
    assert len(text) > bpe.BIG and got == {(1, "a"): want, (1, "c"): want, (2, "b"): library.encode("short", add_special_tokens=False).ids, (3, None): []}
    assert [r["n_tokens"] for r in bpe.round_trip(docs.where("doc_id = 1"), path).collect()] == [len(want)] * 2


def test_op2(spark, table_dir):
    got = lm_score.op2(spark, table_dir).collect()
    rows = rows_of(spark, table_dir)
    held = [zlib.crc32(str("" if i is None else i).encode()) % 5 == 1 for i, _ in rows]
    tokens = [[*words_of(t), b" "] for _, t in rows]
    c = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    total, kinds = sum(c.values()), len(c)
    base = [sum(np.log10((c[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws) for ws in tokens]
    want = Counter((r[0], h, len(ws), sum(c[w] > 0 for w in ws), total, round(b, 5)) for r, h, ws, b in zip(rows, held, tokens, base))
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 for r in got) and sum(r["score"] for r in got if r["n_tokens"] < 3000) > sum(r["base_score"] for r in got if r["n_tokens"] < 3000)


def test_score_by_any_split(spark, table_dir):
    """The model and the scores don't depend on how the rows are split; the classes' counts by brute force."""
    docs = spark.read.parquet(f"{table_dir}/documents.parquet").select("doc_id", "text")
    found = []
    for n in (2, 6):
        own = docs.repartition(n)
        model = lm_score.fit(own)
        found.append(sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm_score.score(own.withColumn("held_out", F.lit(False)), model).collect()))
    assert [r[:2] for r in found[0]] == [r[:2] for r in found[1]] and np.allclose([r[2] for r in found[0]], [r[2] for r in found[1]], rtol=1e-3)
    c = model.counts
    n = {r["h"]: r["n"] for r in c.table.collect()}
    keys = np.array(list(n), np.int64).view(np.uint64)
    ids = lm_score.ids_of(Lookup(c.head).find(keys), keys, len(c.class_n))
    words = np.array(list(n.values()))
    rest = ids >= lm_score.SINGLES
    assert (np.bincount(ids[rest] - lm_score.SINGLES, words[rest], len(c.class_n)) == c.class_n).all()
    assert (np.bincount(ids[rest] - lm_score.SINGLES, minlength=len(c.class_n)) == c.class_kinds).all()


def test_vectors_grow_with_the_words():
    found = [lm_score.classes_for(n) for n in (0, 1_000, 1_000_000, 1_000_000_000)]
    assert found == [1, 60, 600, 6000]


def test_normaliser(monkeypatch):
    monkeypatch.setattr(lm_score, "BATCH", 7)  # contexts at once
    state = lm_score.start(np.full(30, 1 / 30))
    state[:700] += np.random.default_rng(0).normal(0, 0.5, 700).astype(np.float32)
    near, far, norm = lm_score.tables(state, 30)
    p = np.exp(near[None, :, :] + far[:, None, :] - norm[:, :, None])
    assert np.allclose(p.sum(2), 1, atol=1e-4)


def test_noise_contrastive_steps_learn():
    rng = np.random.default_rng(5)
    ids = np.zeros(20000, np.int64)
    for k in range(1, len(ids)):
        ids[k] = (ids[k - 1] + 1) % 5 if rng.random() < 0.9 else rng.integers(5)
    p = np.full(5, 0.2)
    state = lm_score.start(p)
    before, last = lm_score.contexts(ids, np.array([0, len(ids)]))
    for _ in range(30):
        for at in range(0, len(ids), 1024):
            s = slice(at, at + 1024)
            lm_score.train_batch(state, 5, before[s], last[s], ids[s], rng.integers(0, 5, lm_score.NOISE), (np.log(p) + np.log(lm_score.NOISE)).astype(np.float32))
    near, far, norm = lm_score.tables(state, 5)
    assert (near[last, ids] + far[before, ids] - norm[before, last]).mean() > np.log(0.2) + 0.5


def test_op5(spark, table_dir):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{table_dir}/benchmark.parquet").collect()]
    fill = [t for _, t, _ in texts(spark, 60)]
    planted = {i: k % len(bench) for k, i in enumerate(range(2000, 2020))}
    rows = [(i, fill[i % 50][:600] + "\n" + (bench[k][1].upper() if i % 5 == 0 else bench[k][1]) + "\n" + fill[i % 37][:500]) for i, k in planted.items()]
    w = bench[3][1].split()
    rows += [(2100, " ".join([*fill[1].split()[:40], *(x for j, x in enumerate(w) if j % 6), *fill[2].split()[:40]])), (2101, None), (2102, ""), (None, bench[4][1])]
    clean = [(i, t) for i, t in enumerate(fill) if not any(" ".join(b.split()[:6]) in t for _, b in bench)]
    docs = spark.createDataFrame([*rows, *clean], "doc_id long, text string")
    own = spark.createDataFrame([*bench, (900, None), (901, ""), (902, "...")], "item_id long, text string")
    index = decontaminate.fit(docs, own)
    found = decontaminate.find(docs, index).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert {(i, bench[k][0]) for i, k in planted.items()} | {(2100, bench[3][0]), (None, bench[4][0])} <= got
    assert not {i for i, _ in got} & {i for i, _ in clean}
    assert {r[0] for r in decontaminate.keep_unmatched(docs, index).collect()} == {i for i, _ in clean} | {2101, 2102}
    assert decontaminate.find(docs, decontaminate.fit(docs, own.limit(0))).count() == 0


def test_candidates_of_many_items(spark):
    """All copies whose best window reaches the least cosine, by brute force over all features, are found however many items there are."""
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"w{k}" for k in range(6000)])
    share = 1 / np.arange(5, 6005)
    items = [" ".join(rng.choice(vocabulary, rng.integers(15, 60), p=share / share.sum())) for _ in range(1050)]
    rows = [(k, " ".join([*rng.choice(vocabulary, rng.integers(0, 90), p=share / share.sum()), x, *rng.choice(vocabulary, 60, p=share / share.sum())])) for k, x in enumerate(items)]
    docs, own = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    blocks = decontaminate.fit(docs, own)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, blocks).collect()}
    want = set()
    for index in (x for b in blocks for x in b.indexes):
        known = Lookup(index.keys)

        def vector(words, known=known, index=index):
            at = known.find(np.array(words, np.uint64))
            return np.bincount(at[at >= 0], index.weight[at[at >= 0]], len(index.keys))

        for k, words in zip(index.items.ids, index.items.words):
            item = vector(words)
            h = decontaminate.words_of(*utf8(pa.array([rows[k][1]]))).hashes().tolist()
            windows = [vector(h[a : a + 2 * decontaminate.HALF]) for a in range(0, len(h), decontaminate.HALF)]
            if max(w @ item / max(1e-9, np.linalg.norm(w) * np.linalg.norm(item)) for w in windows) >= decontaminate.COSINE + 0.01:
                want.add((k, k))
    assert len(want) > 1000 and not want - got


def test_long_items_and_paraphrases(spark):
    """Verbatim items of 40 to 2,500 words, and short ones with words replaced, against an exact search of all windows."""
    rng = np.random.default_rng(6)
    vocabulary = np.array([f"w{k}" for k in range(4000)])
    share = 1 / np.arange(8, 4008)
    some = lambda n: rng.choice(vocabulary, n, p=share / share.sum()).tolist()
    items = [some(n) for n in [*(40, 300, 600, 1200, 2500) * 3, *rng.integers(16, 60, 60)]]
    rows = [[*some(70), *x, *some(70)] for x in items]
    for k, x in enumerate(items[15:]):
        rows.append([*some(40), *(w if rng.random() > 0.1 + 0.25 * (k % 11) / 10 else f"n{rng.integers(1 << 30)}" for w in x), *some(40)])
    docs = spark.createDataFrame([(k, " ".join(r)) for k, r in enumerate(rows)], "doc_id long, text string").repartition(3)
    own = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, decontaminate.fit(docs, own)).collect()}
    assert {(k, k) for k in range(len(items))} <= got
    wanted = set()
    for k, words in enumerate(rows[len(items) :]):
        item = [int(w[1:]) for w in items[15 + k]]
        near, n = [hash(w) if w[0] == "n" else int(w[1:]) for w in words], len(item)
        spans = [near[a : a + n + n // 2 + 1] for a in range(0, max(1, len(near) - n), n // 2)]
        if any(decontaminate.lcs(decontaminate.masks(item), n, x) / n >= decontaminate.SHARE for x in spans):
            wanted.add((len(items) + k, 15 + k))
    assert len(wanted) > 40 and len(wanted & got) >= 0.9 * len(wanted)


def test_lcs():
    def plain(a, b):
        t = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, t[j + 1] = t[j + 1], max(t[j + 1], t[j], last + 1 if x == y else 0)
        return t[-1]

    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 20)).tolist(), rng.integers(0, 4, rng.integers(0, 30)).tolist()
        assert decontaminate.lcs(decontaminate.masks(a), len(a), b) == plain(a, b)


def test_op1(spark):
    urls = ["https://A.Example.ORG/en/1?x", "http://example.org/en/2", "http://m.example.org/es/", "http://x.com/fr/a#b", "http://x.com/de/", "http://notorg/", "http://x.net/fr/", "no scheme", None, "", "http://org/", "http://x.com", "a://b?c://d", "http://x.com/FR/", "http://x.org"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] * 2, "page_id long, url string")
    learn = spark.read.parquet(f"{TINY}/pages.parquet").select("url")
    verdict = url_filter.rule_of(*url_filter.parts())["verdict"]
    model = url_filter.fit(learn.select("url", (verdict == "allow").alias("allowed")))
    got = {r["page_id"]: r for r in url_filter.judge(pages, model).collect()}

    def plain(u):
        if not u or "://" not in u:
            return "", "", None
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [(len(r), r) for _, r in url_filter.RULES if ((own := r.split("/", 1)[0]) == host or host.endswith("." + own)) and path.startswith("/" + r.split("/", 1)[1])]
        return host, path, max(fits)[1] if fits else None

    for k, u in enumerate(urls):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == plain(u), u
        if got[k]["rule"]:
            assert got[k]["verdict"] == {r: v for v, r in url_filter.RULES}[got[k]["rule"]]
        assert got[k]["verdict"] in ("allow", "block")
    assert got[8]["verdict"] == got[9]["verdict"] == "allow"


def test_op1_edge_cases(spark, tmp_path):
    rows = [(k, f"http://a{k % 7}.org/p{k}", "html", "c") for k in range(60)] + [(60 + k, f"http://b{k % 5}.com/de/q{k}", None, "d") for k in range(60)]
    rows += [(None, "http://x.net/", None, None), (200, "http://y.net/" + "long/" * 200_000, None, None), (200, None, None, None), (201, "", None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string, verdict string").withColumnRenamed("html", "score").write.parquet(str(tmp_path / "pages.parquet"))
    got = url_filter.op1(spark, str(tmp_path)).collect()
    assert Counter(r["page_id"] for r in got) == Counter(r[0] for r in rows) and {r["verdict"] for r in got} <= {"allow", "block"}
    by = {r["page_id"]: r for r in got}
    assert by[None]["host"] == "x.net" and by[201]["verdict"] == "allow" and len(by[3]["path"]) == 3 and by[61]["verdict"] == "block"


def test_markov_is_a_distribution():
    data, offsets = utf8(pa.array(["ab/ab", "abc", "bca"]))
    context, both = url_filter.grams(data, offsets)
    keys, first, n = np.unique(both.ravel(), return_index=True, return_counts=True)
    model = url_filter.Markov(context.ravel()[first], keys, n, np.zeros_like(n))
    probs = []
    for byte in range(256):
        d, o = utf8(pa.array([b"ab".decode() + "x"]))
        d = d.copy()
        d[2] = byte
        c, b = url_filter.grams(d, o)
        p = 1 / 256
        for order in range(url_filter.MAX_ORDER + 1):
            at, of = model.gram.find(b[order, 2:3])[0], model.context.find(c[order, 2:3])[0]
            if model.totals[0, of] > 0:
                p = (model.gram_counts[0, at] + model.kinds[0, of] * p) / (model.totals[0, of] + model.kinds[0, of])
        probs.append(p)
    assert abs(sum(probs) - 1) < 1e-9 and probs[ord("c")] > 0.2


OPS = [url_filter.op1, lm_score.op2, phrase_print.op3, token_files.op4, decontaminate.op5, simhash.op6, length_hist.op7, toxicity.op8, bpe.op9, language.op10]


@pytest.mark.parametrize("op", OPS, ids=lambda op: op.__name__)
def test_empty_tables(spark, empty_dir, op):
    assert op(spark, empty_dir).count() == 0


def test_pipeline(spark, table_dir, empty_dir):
    docs = spark.read.parquet(f"{table_dir}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stage(spark, docs, table_dir)
        if k == 4:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(token_files.tokenizer_path("byte_bpe_50k.json"))
            assert kept.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
            want = Counter((r["doc_id"], tuple(library.encode(r["text"], add_special_tokens=False).ids)) for r in docs.collect())
            assert Counter((r["doc_id"], tuple(r["ids"])) for r in kept.collect()) == want
            break
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
        assert ids <= Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
            group = plain_near_groups(rows)
            want = Counter(min((r[0] for r, g in zip(rows, group) if g == x and r[0] is not None), default=None) for x in set(group))
            assert ids == want
        path = f"{table_dir}/kept-{name}"
        kept.write.parquet(path)
        docs = spark.read.parquet(path)
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
