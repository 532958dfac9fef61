"""The text operators against brute force, round trips and held-out accuracy, with odd rows throughout."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siltscan.llm import chat_tree, components, decontaminate, kk_shards, language_mix, line_quality, lm_scoring, near_copies, piece_codec, simhash_dedup, suffix_dedup, toxicity

rng = np.random.default_rng(3)
WORDS = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in r.integers(0, len(WORDS), n))


BASE = prose(120, 1)
ODD = [
    (1, BASE), (2, BASE), (3, None), (4, ""), (5, " \n\t "), (6, "One"), (7, prose(80, 2) + " é𝔘 " + BASE[50:330]), (8, prose(100, 3)), (9, prose(3000, 4)),
    (10, ("ab " * 200) + "end"), (11, BASE + " changed"), (12, prose(60, 5) + "\n" + prose(60, 5)), (12, prose(60, 5) + "\n" + prose(60, 5)), (13, "x" * 700), (14, prose(40, 6).upper()),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows, with a column whose name an operator might use itself."""
    return spark.createDataFrame([(i, t, "k") for i, t in ODD], "doc_id long, text string, key string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, key string")


def covered(texts, n=200):
    seen = collections.Counter()
    for t in texts:
        seen.update(t[i : i + n] for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        c = np.zeros(len(t) + 1, dtype=int)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                c[i] += 1
                c[i + n] -= 1
        out.append(np.cumsum(c)[:-1] > 0)
    return out


def test_suffix_dedup_is_exact(docs, none):
    texts = [(t or "").encode() for _, t in ODD]
    want = []
    for (i, _), t, c in zip(ODD, texts, covered(texts), strict=True):
        left = bytes(b for b, gone in zip(t, c, strict=True) if not gone)
        want.append((i, len(t), int(c.sum()), int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum()), hashlib.sha256(left).hexdigest()))
    assert sorted(map(tuple, suffix_dedup.removed(docs).collect())) == sorted(want)
    assert suffix_dedup.removed(none).count() == 0


def test_suffix_dedup_counts_windows_of_crowded_hashes(docs, monkeypatch):
    before = sorted(map(tuple, suffix_dedup.removed(docs).collect()))
    monkeypatch.setattr(suffix_dedup, "GROUP", 0)
    assert sorted(map(tuple, suffix_dedup.removed(docs).collect())) == before


def test_suffix_cut_keeps_characters_and_columns(docs):
    out = suffix_dedup.cut_texts(docs)
    assert out.columns == docs.columns and out.count() == len(ODD)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1] == got[2] == "" and got[8] == prose(100, 3) and "é𝔘" in got[7] and got[3] is None


def test_deep_shallow_order():
    rows = np.array([list(s.ljust(60, b"\0")) for s in [b"b" * 50 + b"x", b"b" * 50 + b"a", b"a", b"b" * 50 + b"x", b"c", b"b" * 58]], dtype=np.uint8)
    order, prefix = suffix_dedup.deep_shallow(np.zeros(6, dtype=int), rows)
    assert [rows[i].tobytes() for i in order] == sorted(r.tobytes() for r in rows) and prefix[0] == -1 and 60 in prefix
    strings = [bytes(rng.integers(97, 99, 12).astype(np.uint8)) for _ in range(200)]
    assert [strings[i] for i in suffix_dedup.blind_trie_order(strings)] == sorted(strings)


def brute_print(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, distance=3):
    ids = list(prints)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}


def test_simhash_clusters(docs, none):
    prints = {i: brute_print(t) for i, t in ODD}
    want = brute_components(prints)
    got = simhash_dedup.cluster(docs).collect()
    assert len(got) == len(ODD) and all((r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id]) for r in got)
    assert simhash_dedup.cluster(none).count() == 0


def test_simhash_links_of_crowded_buckets(spark):
    r = np.random.default_rng(5)
    fps = [int(x) for x in r.integers(0, 2**63, 40)]
    for f in list(fps):
        for _ in range(6):
            f ^= 1 << int(r.integers(0, 63)) | 1 << int(r.integers(0, 63))
            fps.append(f)
    fps = sorted(set(fps))
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    for distance, bucket in ((3, 20_000), (3, 2), (7, 20_000)):
        want = brute_components({f: f for f in fps}, distance)
        roots = {x.node: x.root for x in components.components(simhash_dedup.links(frame, distance, bucket)).collect()}
        assert all(roots.get(f, f) == want[f] for f in fps)


@pytest.mark.parametrize("most", [2_000_000, 1000])
def test_near_copies_share_shingles(spark, tmp_path, monkeypatch, most):
    """Copies that share 0.8 of their shingles go, however many bits of their fingerprints differ; others stay."""
    import corpus_pipeline

    monkeypatch.setattr(near_copies, "MOST", most)
    r = np.random.default_rng(11)
    rows = []
    for b in range(8):
        base = prose(150, 300 + b).split()
        for edits in (0, 1, 2, 3, 4, 5, 6, 8):
            w = list(base)
            for i in r.choice(150, edits, replace=False):
                w[i] = f"new{b}x{i}"
            rows.append((len(rows), " ".join(w)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    want = {min(i for i in range(len(rows)) if root[i] == x) for x in set(root)}
    d = spark.createDataFrame([*rows, (1, rows[1][1]), (None, rows[0][1]), (90, None), (91, " ")], "doc_id long, text string")
    got = [x.doc_id for x in corpus_pipeline.near_duplicates(spark, d, str(tmp_path)).collect()]
    assert sorted(x for x in got if x is not None) == sorted(want | {90}) and got.count(None) == 1


def test_driver_garbage_goes_after_writes(spark, monkeypatch):
    """With a heap grown beyond its share, a write ends with a collection of the driver's garbage; below it nothing is done."""
    from siltscan.llm import common

    factory = spark.sparkContext._jvm.java.lang.management.ManagementFactory

    def full() -> int:
        return sum(b.getCollectionCount() for b in factory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())

    monkeypatch.setattr(common, "HEAP", 0.0)
    before = full()
    common.drop(common.materialise(spark.range(3)))
    assert full() > before
    monkeypatch.setattr(common, "HEAP", 1.0)
    before = full()
    common.relieve(spark)
    assert full() == before


def test_line_model_of_repeated_ids(spark, monkeypatch):
    """Rows of one id don't multiply what the driver gathers and fits on; documents without a line stay."""
    seen = []
    monkeypatch.setattr(line_quality, "fit_crf", lambda docs: seen.append(docs))
    rows = [(i, f"{prose(30, i)}\n{prose(20, 50 + i)}") for i in range(6)] + [(6, None), (7, "")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    for times in (1, 40):
        line_quality.train(spark.createDataFrame(rows * times, "doc_id long, text string"), labels)
    once, often = seen
    assert len(once) == len(often) == 8 and [q for _, q in often] == [i % 2 for i in range(8)]
    assert all(np.array_equal(x, y) for (x, _), (y, _) in zip(once, often, strict=True))
    assert all(np.array_equal(x, np.array(line_quality.describe((t or "").encode())[5]).reshape(-1, line_quality.FEATURES)) for (x, _), (_, t) in zip(once, rows, strict=True))


def test_near_copies_by_fingerprints(spark, tmp_path, monkeypatch):
    """Op4's links alone find near copies within 3 bits; of texts with like fingerprints those that share few shingles both stay."""
    import corpus_pipeline

    monkeypatch.setattr(near_copies, "keys", lambda found: np.zeros(0, dtype=np.int64))
    base, often = prose(600, 500).split(), (prose(11, 501) + " ") * 60
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "new"])), (3, prose(600, 502)), (4, often + prose(40, 503)), (5, often + prose(40, 504))]
    prints = [brute_print(t) for _, t in rows]
    assert (prints[0] ^ prints[1]).bit_count() <= 3 and (prints[3] ^ prints[4]).bit_count() <= 3
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, d, str(tmp_path)).collect()) == [1, 3, 4, 5]


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(chain).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_lm_base_scores(docs, none):
    train = [t for i, t in ODD if i % 2]
    counts = collections.Counter(w for t in train for w in [*(t or "").encode().lower().split(), b" "])
    total, distinct = sum(counts.values()), len(counts)
    m, table = lm_scoring.fit(docs.where("doc_id % 2 = 1"))
    got = lm_scoring.score(docs, m, table).collect()
    assert len(got) == len(ODD)
    by = {i: t for i, t in ODD}
    for r in got:
        words = [*(by[r.doc_id] or "").encode().lower().split(), b" "]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words), rel_tol=1e-9) and r.score < 0
    empty, counts0 = lm_scoring.fit(none)
    assert all(r.n_known == 0 for r in lm_scoring.score(docs, empty, counts0).collect()) and lm_scoring.score(none, m, table).count() == 0


def test_lm_rare_tokens_and_normalisation(docs, monkeypatch):
    m, table = lm_scoring.fit(docs)
    want = {(r.doc_id, r.n_known, round(r.base_score, 6)) for r in lm_scoring.score(docs, m, table).collect()}
    monkeypatch.setattr(lm_scoring, "KNOWN", 40)
    m, table = lm_scoring.fit(docs)
    assert {(r.doc_id, r.n_known, round(r.base_score, 6)) for r in lm_scoring.score(docs, m, table).collect()} == want
    t = lm_scoring.numbers([BASE.encode()], {w: i for i, w in enumerate(m.known)})
    f = lm_scoring.features(t)
    for level, (at, node, _) in enumerate(lm_scoring.steps(m, t.index, t.hash)):
        g = f if at is None else f[at]
        p = lm_scoring.chances(m, lm_scoring.rows_of(m, g, level, node), level, node)
        assert len(node) and np.allclose(p.sum(axis=1), 1, atol=1e-4)


def test_lm_matches_a_plain_model(docs):
    """Scores by explicit loops over paths, features and branches, from the trained weights; shares of a leaf's tokens and of unseen ones sum to one."""
    train = docs.where("doc_id % 2 = 1")
    m, counts = lm_scoring.fit(train)
    count = {bytes(r.token): r.n for r in counts.collect()}
    rank = {w: i for i, w in enumerate(m.known)}
    got = {r.doc_id: r.score for r in lm_scoring.score(docs, m, counts).collect()}
    leaves = lm_scoring.TAILS * lm_scoring.WIDE**m.depth

    def slots(word):
        i = rank.get(word, -1)
        if 0 <= i < lm_scoring.DIRECT:
            return [(0, i >> 4), (i >> 4, i & 15)]
        leaf = zlib.crc32(word) & (leaves - 1)
        top = lm_scoring.DIRECT + (leaf >> 4 * m.depth)
        return [(0, top >> 4), (top >> 4, top & 15), *((leaf >> 4 * (m.depth - d + 1), leaf >> 4 * (m.depth - d) & 15) for d in range(1, m.depth + 1))]

    for i, text in ODD[:8]:
        words, total = [*(text or "").encode().lower().split(), b" "], 0.0
        for at, word in enumerate(words):
            codes = np.array([[zlib.crc32(words[at - k]) if at >= k else lm_scoring.BEGIN for k in (1, 2, 3)]], dtype=np.uint64)[0]
            one, two, three = (codes[k : k + 1] for k in range(3))
            f = [lm_scoring.hashed(one, 0), lm_scoring.hashed((one << np.uint64(31)) ^ two, 1), lm_scoring.hashed(two, 2), lm_scoring.hashed(three, 3)]
            for level, (node, branch) in enumerate(slots(word)):
                each = len(m.weights[level]) // len(m.bias[level])
                a, b = (int(lm_scoring.MULTIPLIERS[k]) for k in (0, 2))
                rows = [((int(x) ^ node * b % 2**64) * a % 2**64) >> (65 - each.bit_length()) if each > 1 else 0 for x in np.concatenate(f)]
                logits = m.bias[level][node].astype(float) + sum(m.weights[level][node * each + r].astype(float) for r in rows)
                total += logits[branch] - np.log(np.exp(logits).sum())
            if len(slots(word)) > 2:
                total += np.log((count.get(word, 0) + 1) / m.leaf_mass[zlib.crc32(word) & (leaves - 1)])
        assert math.isclose(got[i], total / np.log(10), rel_tol=1e-4)
    for leaf in range(0, leaves, 37):
        own = [w for w in count if rank[w] >= lm_scoring.DIRECT and zlib.crc32(w) & (leaves - 1) == leaf]
        assert m.leaf_mass[leaf] == sum(count[w] + 1 for w in own) + 1


def test_lm_is_the_same_however_rows_lie(spark):
    """One and eight partitions give the same scores, and held-out texts gain over their token counts."""
    r = np.random.default_rng(8)
    rows = []
    for i in range(300):
        words, w = [], int(r.integers(0, 200))
        for _ in range(80):
            w = (w * 7 + int(r.integers(0, 3))) % 200
            words.append(WORDS[w])
        rows.append((i, " ".join(words)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    scores = []
    for n in (1, 8):
        m, counts = lm_scoring.fit(d.where("doc_id % 3 > 0").repartition(n, "doc_id"))
        scores.append({x.doc_id: (x.score, x.base_score) for x in lm_scoring.score(d, m, counts).collect()})
    a, b = scores
    assert all(math.isclose(a[i][0], b[i][0], rel_tol=1e-3) for i in a)
    held = [i for i in a if i % 3 == 0]
    assert sum(a[i][0] for i in held) > 0.8 * sum(a[i][1] for i in held)


def test_lm_known_tokens_are_bounded_by_a_threshold(spark):
    counts = spark.createDataFrame([(bytearray(str(i).encode()), 1 + i % 50) for i in range(5000)], "token binary, n long")
    for most in (10, 100, 700, 4999, 5000, 10**6):
        n = lm_scoring.threshold(counts, most)
        assert counts.where(F.col("n") >= n).count() <= most
    assert lm_scoring.threshold(counts, 5000) == 1


def test_pieces_round_trip_and_match_the_library(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL)
    got = piece_codec.encode(docs, dropout=0.0).collect()
    by = {i: t for i, t in ODD}
    assert all(r.ids == sp.encode(by[r.doc_id] or "") and r.lossless for r in got)
    varied = piece_codec.encode(docs).collect()
    assert all(r.lossless for r in varied) and sum(r.n_pieces for r in varied) > sum(r.n_pieces for r in got)
    assert varied == piece_codec.encode(docs).collect() and piece_codec.encode(none).count() == 0
    v = piece_codec.opened(piece_codec.MODEL)
    odd = ["▁ a▁", "a\x00b", "日本語" * 30, "y" * 90, "\n \n"]
    ids, n = piece_codec.encode_batch(v, odd, list(range(len(odd))))
    assert [x.decode() for x in piece_codec.decode_batch(v, ids, n)] == odd


def test_agendas_agree():
    v = piece_codec.opened(piece_codec.MODEL)
    for word in (" thereafter", "unbelievable", " é x", "aaaaaaa"):
        chars = v.char[[ord(c) for c in word]].astype(np.int32)
        for key in range(25):
            for rate in (0.0, 0.1, 0.6):
                cut = int(rate * 2**64)
                many, _ = piece_codec.segment_many(v, chars[None], np.array([key], dtype=np.uint64), cut)
                assert piece_codec.segment_heap(v, chars.tolist(), key, cut) == many[many >= 0].tolist()


def test_leaks_found_and_clean_left(spark, docs, none):
    item = prose(40, 50) + ". " + prose(8, 51) + "."
    words = item.split()
    changed = " ".join(w if i % 9 else "other" for i, w in enumerate(words[:-8])) + " " + " ".join(words[-8:])
    rows = [(100, prose(90, 60) + " " + item + " " + prose(90, 61)), (101, prose(30, 62) + " " + changed), (102, item.upper()), (103, prose(400, 63)), (104, " ".join(words[:15])), (105, None)]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (4, prose(30, 70), "x"), (1, item, "x")], "item_id long, text string, doc_id string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, bench).collect()} == {(100, 1), (101, 1), (102, 1)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, bench, block_items=1).collect()} == {(100, 1), (101, 1), (102, 1)}
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(d, bench.limit(0)).count() == 0


def test_reworded_leaks_found_beside_common_words(spark):
    """Item words that every document holds weigh little; words foreign to the benchmark must not hide them."""
    words = prose(48, 52).split()
    item = " ".join(words[:40]) + ". " + " ".join(words[40:]) + "."
    r = np.random.default_rng(5)
    rows = [(i, " ".join(r.permutation([*set(words), *prose(150, 400 + i).split()]))) for i in range(200)]
    rows.append((900, prose(30, 53) + " " + " ".join(f"new{i}" if i % 6 == 3 else w for i, w in enumerate(words)) + " " + prose(30, 54)))
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(900, 1)}


@pytest.mark.parametrize("rate", [0, 0.1, 0.2, 0.3])
def test_reworded_leaks_are_found_and_clean_left(spark, rate):
    """Of items with a share of words replaced, 0.9 are found; documents that hold none are left alone."""
    r = np.random.default_rng(21)
    items, rows = [], []
    for i in range(60):
        words = [WORDS[x] for x in r.integers(0, 300, int(r.integers(20, 60)))]
        answer = int(r.integers(4, 9))
        items.append((i, " ".join(words[:-answer]) + ". " + " ".join(words[-answer:]) + "."))
        new = [f"other{r.integers(0, 10**6)}" if r.random() < rate else w for w in items[-1][1].split()]
        rows.append((i, prose(80, 1000 + i) + " " + " ".join(new) + " " + prose(80, 2000 + i)))
        rows.append((100 + i, prose(250, 3000 + i)))
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    right = {(i, i) for i, _ in items}
    assert len(got & right) >= 54 and not got - right


@pytest.mark.parametrize("length", [8, 11, 15, 17, 22, 30])
def test_verbatim_items_are_found_at_any_place(spark, length):
    """Wherever windows lie, an item among other words is found."""
    items = [(i, prose(length, 5000 + i)) for i in range(40)]
    rows = [(i, prose(20 + i, 6000 + i) + " " + t + " " + prose(90, 7000 + i)) for i, t in items]
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got & {(i, i) for i, _ in items}) >= (39 if length > 10 else 37) and len(got) <= 40


def test_short_items_match_word_by_word(spark):
    items = [(1, "Quarzo vexnim polt."), (2, "zzyzx"), (3, WORDS[0] + " qqq"), (4, "?"), (5, "one two three four five six seven")]
    rows = [(1, prose(50, 5) + " quarzo VEXNIM, polt " + prose(50, 6)), (2, "quarzo polt vexnim"), (3, "a zzyzx b"), (4, "one two three four five six"), (5, "zero one two three four five six seven eight"), (None, "zzyzx"), (6, "quarzo"), (7, "vexnim polt")]
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1), (3, 2), (5, 5), (None, 2)}


def test_leaks_of_every_text_of_an_item(spark, monkeypatch):
    """Several texts under one id are all sought; counts of terms are the same when they come by a join; long texts go tile by tile."""
    items = [(1, prose(30, 31)), (1, prose(30, 32)), (2, prose(30, 33))]
    rows = [(1, prose(200, 34) + " " + items[0][1]), (2, items[1][1] + " " + prose(200, 35)), (3, prose(9000, 36) + " " + items[2][1] + " " + prose(9000, 37))]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(1, 1), (2, 1), (3, 2)}
    assert {(x.doc_id, x.item_id) for x in decontaminate.leaks(d, b).collect()} == want
    counts = {bytes(x.term): x.n for x in decontaminate.document_frequencies(d, b).collect()}
    monkeypatch.setattr(decontaminate, "FEW_TERMS", 0)
    monkeypatch.setattr(decontaminate, "TILE", 64)
    assert {bytes(x.term): x.n for x in decontaminate.document_frequencies(d, b).collect()} == counts and counts[b""] == 3
    assert {(x.doc_id, x.item_id) for x in decontaminate.leaks(d, b, block_items=1).collect()} == want


def test_lcs():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(100):
        a, b = (list(rng.integers(0, 5, rng.integers(1, 40))) for _ in range(2))
        assert decontaminate.lcs(a, b)[0] == plain(a, b)


def test_stretches_that_hold_an_item():
    """Overlapping stretches, summed together, give what a plain sum over each span gives; so do stretches far apart."""
    r = np.random.default_rng(31)
    code, weight = r.integers(0, 9, 3000), r.random(9).astype(np.float32)
    for cap in (5, 40, 90):
        low = r.integers(0, 2950, 400)
        top = np.minimum(low + r.integers(1, 80, 400), 3000)
        sums = [max(float(weight[code[p : min(p + cap, b)]].sum(dtype=float)) for p in range(a, b)) for a, b in zip(low.tolist(), top.tolist(), strict=True)]
        for least in (0.3 * cap, 0.5 * cap, 0.6 * cap):
            want = [s >= least for s in sums]
            assert decontaminate.holding(code, weight, low, top, cap, least).tolist() == want
            assert [bool(decontaminate.holding(code, weight, low[i : i + 1], top[i : i + 1], cap, least)[0]) for i in range(400)] == want


def test_svd_spans_the_rows(spark):
    a = np.random.default_rng(1).standard_normal((60, 5)) @ np.random.default_rng(2).standard_normal((5, 30))
    v = decontaminate.randomised_svd(spark, spark.createDataFrame([(list(range(30)), [float(x) for x in r]) for r in a], "ids array<int>, weights array<float>").repartition(3), 30, 5)
    assert np.allclose(a @ v @ v.T, a, atol=1e-2)


def test_chat_tree_reads_back(spark):
    hot = [(i, 0, "user", "same first turn") for i in range(700)] + [(i, 1, "assistant", f"answer {i % 400} [/INST] \\[INST]</s>") for i in range(700)]
    odd = [(1000, 0, "system", "[SAYS] be \\ kind"), (1000, 1, "user", None), (1000, 2, "assistant", "x" * 5000), (1001, 0, "assistant", ""), (1002, 0, None, "t"), (1003, 5, "user", "b"), (1003, 2, "tool [/ROLE]", "a"), (1004, 0, "user", "dup"), (1004, 0, "user", "dup")]
    rows = hot + odd
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    named = chat_tree.turns(frame)
    packed = chat_tree.packs(named, paths=50)
    found = {bytes(r.leaf): r for r in chat_tree.read_back(packed).collect()}
    said = collections.defaultdict(list)
    for c, t, r, x in rows:
        said[c].append((t, r or "", x or ""))
    heads = named.where("depth = 0").select("conv_id", "leaf").collect()
    assert len(heads) == len(said)
    for h in heads:
        turns, r = sorted(said[h.conv_id]), found[bytes(h.leaf)]
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert r.read_turns == len(turns) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat_tree.segment(role, x)[0]) for _, role, x in turns)
    for p in packed.collect():  # shared turns once; intervals are ancestors and self, positions count along them
        names = [bytes(n.node) for n in p.nodes]
        assert len(names) == len(set(names)) and sum(n.end - n.start for n in p.nodes) == len(p.text)
        for n in p.nodes:
            assert n.position == sum(a.end - a.start for a in n.attends) - (n.end - n.start)
    assert chat_tree.packs(chat_tree.turns(frame.limit(0))).count() == 0


def test_quality_counts(docs, none, spark):
    labels = spark.createDataFrame([(8, 1), (9, 1), (10, 0), (13, 0)], "doc_id long, quality int")
    rows = docs.unionByName(spark.createDataFrame([(20, "|".join([" w "] * 60) + "\nfine line here\nfine line here\n\n", "k"), (21, prose(30, 8) + "\n" + " ".join(["A$$$", "B%%%"] * 30), "k")], docs.schema))
    model = line_quality.train(rows, labels)
    got = {r.doc_id: r for r in line_quality.judge(rows, model).collect()}
    for r in rows.collect():
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", r.text or "") if w]
        grams = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        twice = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (r.text or "").split("\n") if x.split()]
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_repeat_words, g.n_dup_lines) == (len(words), sum(map(len, words)), len(twice), len(lines) - len(set(lines)))
        assert g.n_symbols == sum(c in "#*$%&|<>" for c in r.text or "") and g.base_failed == (len(words) < 20 or 100 * len(twice) > 30 * len(words))
    assert got[8].kept and got[9].kept and not got[20].kept and not got[21].kept and not got[3].kept
    assert line_quality.judge(none, line_quality.train(none, labels.limit(0))).count() == 0


def test_quality_trains_on_all_lines(spark):
    """A low text whose boilerplate begins after line 60 teaches by those lines."""
    clean = [prose(12, 900 + i) + "." for i in range(75)]
    low = "\n".join([*clean[:65], *(["| home | login | menu |"] * 40)])
    texts = {1: (low, 0), 2: ("\n".join(clean[5:]), 1)}
    d = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    model = line_quality.train(d, spark.createDataFrame([(i, q) for i, (_, q) in texts.items()], "doc_id long, quality int"))
    lines = [(np.array(line_quality.describe(t.encode())[5]), q) for t, q in texts.values()]
    assert [len(x) for x, _ in lines] == [105, 70]
    whole, cut = line_quality.fit_crf(lines), line_quality.fit_crf([(x[:60], q) for x, q in lines])
    assert np.allclose(model["w"], whole["w"]) and not np.allclose(model["w"], cut["w"])
    assert line_quality.label_lines(low, model) == ["content"] * 65 + ["boilerplate"] * 40


def test_viterbi():
    from itertools import product

    r = np.random.default_rng(2)
    trans, lengths = r.standard_normal((2, 2)), np.array([1, 6, 3])
    unary = r.standard_normal((10, 2))
    got, at = line_quality.viterbi(unary, lengths, trans), 0
    for n in lengths:
        u = unary[at : at + n]
        best = max(product((0, 1), repeat=int(n)), key=lambda y: sum(u[i, y[i]] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
        assert tuple(got[at : at + n]) == best
        at += n


def test_toxicity_held_out(spark, none):
    def text(i):
        words = prose(90, 100 + i).split()
        if i % 3 == 0:
            for k in range(4):
                words.insert(20 * k + i % 7, ["vilefool", "grimscum"][k % 2])
        return " ".join(words)

    rows = [(i, text(i)) for i in range(240)]
    d = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, "!!"), (1003, "word"), (1004, prose(5000, 9) + " vilefool grimscum " + prose(5000, 10))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(160)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    net = toxicity.train(d, labels)
    got = {r.doc_id: r.score for r in toxicity.score(d, net).collect()}
    assert sum((got[i] >= 0.7) == (i % 3 == 0) for i in range(160, 240)) >= 76
    assert got[1000] == got[1001] == got[1002] == toxicity.EMPTY and got[1004] >= 0.7 and all(0 <= s <= 1 for s in got.values())
    assert toxicity.train(d, labels.limit(0)) is None and toxicity.score(none, net).count() == 0
    assert {r.score for r in toxicity.score(d, None).collect()} == {toxicity.EMPTY}


def test_toxicity_gradients():
    net = toxicity.Network([b"aa", b"bb"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words, index = [b"aa", b"bb", b"xyz"], np.array([[0, 1, 2, 0], [2, 2, 1, 1]])
    mask, y = np.array([[1, 1, 1, 0], [1.0, 1, 1, 1]]), np.array([1.0, 0.0])

    def loss():
        z = net.forward(np.matmul(net.inputs(words)[0], net.p["x"]) + net.p["bias"], index, mask).astype(float)
        return float(np.mean(np.log1p(np.exp(-z * (2 * y - 1)))))

    for k, g in net.gradients(words, index, mask, y).items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = net.p[k][i]
        net.p[k][i] = old + 0.01
        up = loss()
        net.p[k][i] = old - 0.01
        down = loss()
        net.p[k][i] = old
        assert math.isclose((up - down) / 0.02, g[i], rel_tol=2e-3, abs_tol=1e-6), k


def test_language_held_out(spark, none):
    letters = {"aa": "abcdef", "bb": "defghi", "cc": "uvwxyz"}

    def text(lang, i):
        r = np.random.default_rng(i)
        return " ".join("".join(r.choice(list(letters[lang]), 5)) for _ in range(40))

    rows = [(i, text(lang, i), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    train = spark.createDataFrame(rows[:90], "doc_id long, text string, lang string")
    langs, logp = language_mix.train(train)
    test = [(i, t) for i, t, _ in rows[90:]] + [(500, None), (501, ""), (502, "123 !?"), (503, text("aa", 900) + " " + text("cc", 901)), (504, text("aa", 902).upper())]
    got = {r.doc_id: r for r in language_mix.identify(spark.createDataFrame(test, "doc_id long, text string"), langs, logp).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[90:])
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (500, 501, 502)) and got[503].languages == ["aa", "cc"] and got[504].lang_pred == "aa"
    assert language_mix.train(train.limit(0))[0] == [] and language_mix.identify(none.select("doc_id", "text"), langs, logp).count() == 0


def test_shards(docs, none):
    got = kk_shards.shard_documents(docs.select("doc_id", "text"), shards=4).collect()
    assert len(got) == len(ODD)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    text = {i: t or "" for i, t in ODD}
    assert all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)
    assert len({r.shard for r in got if text[r.doc_id] == BASE}) == 1
    assert kk_shards.shard_documents(none.select("doc_id", "text")).count() == 0


def test_differencing_balances_over_a_tree(spark):
    sizes = [int(x) for x in np.random.default_rng(4).integers(100, 100_000, 3000)]
    groups = spark.createDataFrame(list(enumerate(sizes)), "id long, size long")
    for chunk in (16384, 200):
        placed = kk_shards.kk_assign(groups, 24, chunk).collect()
        total = collections.Counter()
        for r in placed:
            total[r.shard] += sizes[r.id]
        assert len(placed) == 3000 and max(total.values()) - min(total.values()) < 2000


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    item = prose(30, 80)
    rows = [(1, prose(150, 81)), (2, prose(150, 81)), (3, prose(60, 82) + " " + item), (4, "too short"), (5, prose(100, 83) + " " + prose(50, 84)), (6, prose(90, 85) + " " + prose(50, 84)), (7, None), (8, prose(120, 86))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(9, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    v = piece_codec.opened(piece_codec.MODEL)
    assert set(out) == {1, 5, 6, 8} and all(r.lossless for r in out.values())
    texts = {i: piece_codec.decode_batch(v, np.array(r.ids, dtype=np.int32), np.array([len(r.ids)]))[0].decode() for i, r in out.items()}
    assert texts[1] == rows[0][1] and prose(50, 84)[20:-20] not in texts[5] + texts[6] and texts[5].startswith(prose(100, 83)[:400])
    assert [k for k, _ in corpus_pipeline.STAGES][0] == "quality_rules" and F is not None
