"""Every registered query through its entry, over one set of odd tables, against plain versions."""

import collections
import hashlib
import heapq
import math
import zlib

import numpy as np
import pytest
import xxhash

from siltscan.llm import kk_shards, language_mix, piece_codec, registry

R = np.random.default_rng(77)
WORDS = ["".join(R.choice(list("abcdefghijklmno"), int(R.integers(3, 9)))) for _ in range(400)]
OTHER = ["".join(R.choice(list("pqrstuvwxyzñé"), int(R.integers(3, 9)))) for _ in range(400)]


def prose(n, seed, words=WORDS):
    return " ".join(words[i] for i in np.random.default_rng(seed).integers(0, len(words), n))


ITEM = prose(30, 1) + ". " + prose(6, 2) + "."
LONG = prose(400_000, 3) + " " + ITEM + " " + prose(400_000, 4)
ROWS = [
    (1, prose(120, 10), "aa"), (2, prose(120, 10), "aa"), (None, prose(90, 11), "aa"), (None, None, None), (3, None, "aa"), (4, "", "bb"), (5, " \n ", None), (6, "One", "aa"), (7, LONG, "aa"),
    (8, prose(60, 12) + " " + ITEM.upper() + " " + prose(60, 13), "aa"), (9, prose(80, 14, OTHER), "bb"), (9, prose(80, 14, OTHER), "bb"), (9, prose(70, 15), "aa"), (10, "日本 " * 40 + "\U0001d518 ▁ x", None),
    *((i, prose(40 + i, 100 + i, WORDS if i % 2 else OTHER), "aa" if i % 2 else "bb") for i in range(20, 60)), (61, prose(100, 16) + " changed", "aa"), (62, prose(100, 16) + " altered", "aa"),
]
CLASHES = ["kept", "_key", "text_crc32", "key", "n words", "rid", "score", "c1", "bucket"]


@pytest.fixture(scope="module", params=["rows", "none"])
def tables(spark, tmp_path_factory, request):
    folder = str(tmp_path_factory.mktemp(request.param))
    rows = ROWS if request.param == "rows" else []
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    spark.createDataFrame([(i, t, x, "s", len(t or ""), *("own" for _ in CLASHES)) for i, t, x in rows], schema).repartition(3).write.option("parquet.block.size", 1 << 20).parquet(f"{folder}/documents.parquet")
    some = [i for i, *_ in rows if i is not None and i >= 20]
    spark.createDataFrame([*((i, 1, i % 2) for i in some), *([(None, 0, 1)] if rows else [])], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, "x y")] if rows else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    said = [(5, 0, "user", "a [INST] \\ b"), (5, 1, "assistant", None), (6, 0, None, "x"), (7, 0, "user", "a [INST] \\ b"), (7, 1, "assistant", "b" * 3_000_000)] if rows else []
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder, rows


def run(spark, tables, n):
    name, f = next((k, f) for k, f in registry.queries().items() if k.startswith(f"op{n}_"))
    return f(spark, tables[0]).collect()


def sorted_rows(rows):
    return sorted(rows, key=str)


def held(i, modulus, remainder):
    return i is not None and zlib.crc32(str(i).encode()) % modulus == remainder


def test_op1_counts_and_base(spark, tables):
    rows = tables[1]
    count = collections.Counter(w for i, t, _ in rows if not held(i, 7, 2) for w in [*(t or "").encode().lower().split(), b" "])
    total, distinct, want = sum(count.values()), len(count), []
    for i, t, _ in rows:
        words = [*(t or "").encode().lower().split(), b" "]
        want.append((i, held(i, 7, 2), len(words), sum(count[w] > 0 for w in words), total, round(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in words), 3)))
    got = run(spark, tables, 1)
    assert sorted_rows((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == sorted_rows(want) and all(r.score < 0 for r in got)


def test_op2_against_counted_windows(spark, tables):
    rows = tables[1]
    texts = [(t or "").encode() for _, t, _ in rows]
    seen = collections.Counter(xxhash.xxh3_64_intdigest(t[i : i + 200]) for t in texts for i in range(len(t) - 199))
    want = []
    for (i, *_), t in zip(rows, texts, strict=True):
        edge = np.zeros(len(t) + 201, dtype=int)
        at = [k for k in range(len(t) - 199) if seen[xxhash.xxh3_64_intdigest(t[k : k + 200])] > 1]
        np.add.at(edge, at, 1)
        np.add.at(edge, np.array(at, dtype=int) + 200, -1)
        gone = np.cumsum(edge)[: len(t)] > 0
        want.append((i, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()).hexdigest()))
    assert sorted_rows(tuple(r)[:5] for r in run(spark, tables, 2)) == sorted_rows(want)


def test_op3_against_a_plain_agenda(spark, tables):
    """Dropout above zero: every merge in turn is the best one that its keyed hash doesn't skip."""
    v, cut = piece_codec.opened(piece_codec.MODEL), int(piece_codec.DROPOUT * 2**64)
    m64, mix = piece_codec.M64, piece_codec.mix_int

    def plain(doc_id, text):
        out, base = [], mix(doc_id + piece_codec.SEED)
        for place, chunk in enumerate(piece_codec.CHUNK.findall(" " + text) if text else []):
            power, digest = 1, 0
            for c in chunk:
                power = power * piece_codec.C1 & m64
                digest += (ord(c) + 1) * power
            key = mix(digest + mix(base + place * piece_codec.C1))
            parts = [(int(v.char[ord(c)]), i) for i, c in enumerate(chunk)]
            while True:
                best = None
                for i in range(len(parts) - 1):
                    made = v.pairs.get((parts[i][0], parts[i + 1][0]))
                    if made is None or mix(key ^ (parts[i][1] * piece_codec.C1 & m64) ^ (made * piece_codec.C3 & m64)) < cut:
                        continue
                    if best is None or v.rank[made] < best[0]:
                        best = v.rank[made], i, made
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [(best[2], parts[best[1]][1])]
            for p, _ in parts:
                out += [p] if p < v.size else [int(v.byte[b]) for b in chr(p - v.size).encode()]
        return out

    got = run(spark, tables, 3)
    assert len(got) == len(tables[1]) and all(r.lossless for r in got)
    assert sorted_rows((r.doc_id, list(r.ids)) for r in got if r.doc_id != 7) == sorted_rows((i, plain(i or 0, t or "")) for i, t, _ in tables[1] if i != 7)
    words = collections.defaultdict(set)
    for r in got:
        if r.doc_id == 7:
            text, ids = LONG.split(" "), iter(r.ids)
            for word in text[:3000]:
                spelt, own = b"", []
                while spelt != (" " + word).encode():
                    own.append(next(ids))
                    spelt += v.bytes_of[own[-1]]
                words[word].add(tuple(own))
    assert not words or max(map(len, words.values())) > 3


def test_op4_against_all_pairs(spark, tables):
    rows, prints = tables[1], []
    for _, t, _ in rows:
        words = (t or "").encode().lower().split()
        hs = np.array([xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))], dtype=np.uint64) if words else np.zeros(0, dtype=np.uint64)
        prints.append(sum(1 << b for b in range(64) if 2 * int((hs >> np.uint64(b) & np.uint64(1)).sum()) > len(hs)))
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root = [root[b] if x == root[a] else x for x in root]
    least = {x: min((rows[k][0] for k in range(len(rows)) if root[k] == x and rows[k][0] is not None), default=None) for x in set(root)}
    assert sorted_rows(tuple(r)[:3] for r in run(spark, tables, 4)) == sorted_rows((rows[k][0], f"{prints[k]:016x}", least[root[k]]) for k in range(len(rows)))


def test_op5_finds_planted_items(spark, tables):
    assert {(r.doc_id, r.item_id) for r in run(spark, tables, 5)} == ({(7, 1), (8, 1)} if tables[1] else set())


def test_op6_reads_back(spark, tables):
    got = {r.conv_id: r for r in run(spark, tables, 6)}
    assert set(got) == ({-1, 5, 6, 7} if tables[1] else {-1})
    assert got[-1].loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest() and got[-1].n_turns == 2
    if tables[1]:
        assert got[7].loss_chars == 3_000_000 and got[5].loss_chars == 0 and got[5].turns_sha256 == hashlib.sha256(b"user\na [INST] \\ b\nassistant\n\n").hexdigest()


def test_op7_counts(spark, tables):
    want = []
    for i, t, _ in tables[1]:
        words = (t or "").encode().split()
        grams = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        twice = {j for k in range(len(words) - 7) if grams[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        want.append((i, len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(twice), len(words) < 20 or 100 * len(twice) > 30 * len(words)))
    got = run(spark, tables, 7)
    assert sorted_rows((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted_rows(want)
    assert all(not (r.base_failed and r.kept) for r in got) and (not got or any(r.kept for r in got))


def test_op8_scores(spark, tables):
    got = run(spark, tables, 8)
    assert sorted_rows((r.doc_id, r.held_out) for r in got) == sorted_rows((i, held(i, 3, 1)) for i, *_ in tables[1])
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_op9_languages(spark, tables):
    got = run(spark, tables, 9)
    assert sorted_rows((r.doc_id, r.held_out) for r in got) == sorted_rows((i, held(i, 4, 2)) for i, *_ in tables[1])
    label = {(i, x) for i, t, x in tables[1] if x and t and t.strip() and i != 6}
    assert all((r.doc_id, r.lang_pred) in label for r in got if r.doc_id is not None and any(i == r.doc_id for i, _ in label))
    assert all(r.score == 0 for r in got if r.lang_pred == "und") and sum(r.lang_pred == "und" for r in got) == sum(not any(c.isalpha() for c in t or "") for _, t, _ in tables[1])


def test_mixture_against_a_plain_one():
    """Proportions by explicit loops; five languages in one text are all told."""
    r = np.random.default_rng(3)
    logp = np.log(r.dirichlet(np.full(language_mix.BUCKETS, 0.02), 5) * 0.99 + 0.01 / language_mix.BUCKETS)
    text = prose(300, 5)
    label, score, chosen = language_mix.infer([text], list("abcde"), logp)
    _, bucket, count, _ = language_mix.grams([text])
    p, best = np.exp(logp.T)[bucket], None

    def fit(share, rounds):
        for _ in range(rounds):
            share = np.array([sum(n * row[k] * share[k] / (row @ share) for row, n in zip(p, count, strict=True)) for k in range(5)]) / count.sum()
        return share, sum(n * math.log(row @ share) for row, n in zip(p, count, strict=True))

    full, _ = fit(np.full(5, 0.2), language_mix.ROUNDS)
    for m in range(1, 6):
        some = np.where(np.argsort(np.argsort(-full, kind="stable")) < m, full + 1e-6, 0)
        some, ll = fit(some / some.sum(), 4 if m > 1 else 0)
        value = ll - m * (0.5 * math.log(count.sum() + 1) + language_mix.PER_GRAM * count.sum())
        if best is None or value > best[0]:
            best = value, some
    assert label[0] == "abcde"[int(best[1].argmax())] and abs(score[0] - best[1].max()) < 1e-3 and chosen[0] == ["abcde"[k] for k in np.flatnonzero(best[1] > 0)]
    alphabets = ["abcd", "efgh", "ijkl", "mnop", "qrst"]
    texts = [" ".join("".join(r.choice(list(a), 5)) for _ in range(400)) for a in alphabets]
    table = np.full((5, language_mix.BUCKETS), 0.1)
    for k, t in enumerate(texts):
        _, b, n, _ = language_mix.grams([t])
        np.add.at(table[k], b, n)
    assert language_mix.infer([" ".join(texts)], list("abcde"), np.log(table / table.sum(axis=1, keepdims=True)))[2] == [list("abcde")]


def test_op10_against_plain_differencing(spark, tables):
    rows = tables[1]
    got = run(spark, tables, 10)
    assert sorted_rows((r.doc_id, r.size, r.text_crc32) for r in got) == sorted_rows((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    if not rows:
        return
    groups = collections.Counter()
    for _, t, _ in rows:
        groups[t or ""] += len((t or "").encode()) + 8
    heap = [(-s, k, [s] + [0] * (kk_shards.SHARDS - 1)) for k, s in enumerate(groups.values())]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, k, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        c = sorted((x + y for x, y in zip(sorted(a, reverse=True), sorted(b), strict=True)), reverse=True)
        heapq.heappush(heap, (c[-1] - c[0], k + 1000, c))
    total, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        total[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(total.values(), reverse=True)[:3] == sorted(heap[0][2], reverse=True)[:3] and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_stages_of_the_pipeline(spark, tables):
    """Each stage on the odd tables: the columns stay (whatever their names), and the rows that belong stay."""
    import corpus_pipeline

    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is null or doc_id <> 7")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        kept[name] = out.collect()
        assert all(r["n words"] == r["_key"] == "own" for r in kept[name])
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count() == len(kept["repeated_strings"])
    if rows:
        ids = collections.Counter(r.doc_id for r in kept["near_duplicates"])
        assert ids[1] == 1 and ids[2] == 0 and ids[9] == 2 and ids[61] + ids[62] == 1 and ids[None] == 2
        assert collections.Counter(r.doc_id for r in kept["benchmark_leaks"])[8] == 0 and len(kept["benchmark_leaks"]) == docs.count() - 1


def test_shared_folder(spark, monkeypatch):
    """Without a shared folder a cluster is refused; what is written is deleted when it is let go."""
    from siltscan.llm import common

    frame = common.materialise(spark.range(5))
    path = frame._written
    assert frame.count() == 5 and path in common._written
    common.drop(frame)
    assert path not in common._written and not __import__("os").path.exists(path.removeprefix("file://"))
    with common.Scratch() as inner:
        a, b = common.materialise(spark.range(3)), common.materialise(spark.range(4))
        inner.keep(b)
    assert a._written not in common._written and b.count() == 4

    class Unset:
        master, applicationId = "spark://host:7077", "none"

        class _jsc:
            @staticmethod
            def sc():
                return Unset._jsc

            @staticmethod
            def getCheckpointDir():
                return Unset._jsc

            @staticmethod
            def isDefined():
                return False

    class Session:
        sparkContext = Unset

        class conf:
            @staticmethod
            def get(_name, default):
                return default

    with pytest.raises(ValueError):
        common.shared_dir(Session)
    Unset.master = "local[4]"
    assert common.shared_dir(Session).startswith("file://")


def test_op2_lets_go_of_what_it_has_read(spark):
    """Shuffle files go when the table made of them is written, tables when the next ones are: of op2's only those of the result stay."""
    from siltscan.llm import common, suffix_dedup

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}

    docs = spark.createDataFrame([(i, prose(60, i // 2) + " " + prose(60, 900)) for i in range(12)], "doc_id long, text string")
    tables, files = set(common._written), shuffled()
    out = suffix_dedup.removed(docs)
    assert len(set(common._written) - tables) == 2 and not shuffled() - files
    assert out.where("n_removed = n_bytes").count() == 12
