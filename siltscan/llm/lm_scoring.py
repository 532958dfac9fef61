"""Language-model scoring with a hashed maximum-entropy model.

Tokens are lower-cased (A-Z) words and one end per text. Token counts come from all training texts (partial sums per task, then one sum
per token). Every token has a path in a tree of classes, 16 branches a node: the `DIRECT` commonest tokens end after two steps, all others
(seen or not) go to one of 32 classes and on through subclasses by their hash. The tree is as deep as the number of distinct tokens
asks for (`depth_of`). The model is the product, over a path, of P(branch | node, context), each a softmax over
weights of hashed features: the word before, the two before, and the words two and three before (skips), whatever these words are. A
leaf that several tokens share is divided by their smoothed counts, so the distribution covers every token.

Training is a few rounds of distributed gradient updates. A round takes the training rows that a hash deals to it (each row belongs to one
round), every task adds up observed and expected branch counts of its rows under the same weights, the sums meet by block
of weights, and one step is taken: the gradient (observed less expected) over the logarithmic mean of both. In the first round, which takes
most rows, weights are zero and every node's shares known, so expected counts follow from the observed ones. Sums don't
depend on how rows lie in tasks, so neither does the model (but for rounding). Texts are scored in sparse numpy batches: only the
weights of features met are read.

Bounds: counts of at most `KNOWN` common tokens are broadcast (a threshold on counts, found from a histogram of counts), those of all others are
joined by token; leaves are at most 32 * 16 ** `DEEPEST` and weights `MOST_ROWS` * 16 a step of the paths, both growing with the input up to that. Beyond it leaves
hold more tokens and features share rows more often; nothing is left out. Every score covers the whole text.

Laws for odd input: a null or empty text is one end token; a null doc_id counts as a training row; without training rows every token is
unseen; very long texts are one row of a batch of their own; repeated rows are scored (and count) each by itself; ties in count go to
the lesser token; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscan.llm.common import by_bytes, byte_column, held_out, materialise, table, words_of

END = b" "  # no word holds a space
WIDE = 16
DIRECT, TAILS = 224, 32
#: Least and largest number of steps below the 32 classes; distinct tokens a leaf should have.
SHALLOWEST, DEEPEST, PER_LEAF = 1, 4, 512
KNOWN = 1 << 17
#: Rows of weights of each step: a power of two, about one for `PER_ROW` training tokens within the bounds.
LEAST_ROWS, MOST_ROWS, PER_ROW = 1 << 12, 1 << 17, 32
#: Of so many parts of the training rows, those of the first round; each other round has one.
PARTS, FIRST = 32, 30
#: Share of a full step, in the first round and after it; counts added to observed and expected ones.
FIRST_RATE, RATE, PRIOR = 0.5, 0.2, 4.0
BLOCK = 256
FLUSH = 400_000
BATCH = 8192
BEGIN = 1 << 32  # no word's hash
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def hashed(x: np.ndarray, j: int) -> np.ndarray:
    """Hash of feature j's value."""
    x = (x + np.uint64(1)) * MULTIPLIERS[j]
    x ^= x >> np.uint64(31)
    return x * MULTIPLIERS[3 - j]


def count_tokens(docs: DataFrame) -> DataFrame:
    """(text) -> (token binary, n long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])
            seen.clear()
            return out

        for batch in by_bytes(batches, "text", 2 << 20):
            texts = byte_column(batch, "text")
            for text in texts:
                seen.update(words_of(text))
            seen[END] += len(texts)
            if len(seen) > FLUSH:
                yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def depth_of(distinct: int) -> int:
    """Steps below the classes for so many distinct tokens."""
    depth = SHALLOWEST
    while depth < DEEPEST and TAILS * WIDE**depth * PER_LEAF < distinct:
        depth += 1
    return depth


def leaf_column(depth: int):
    """The leaf of a token (binary column) among TAILS * WIDE ** depth, as `leaf_of` has it."""
    return F.crc32("token").bitwiseAND(F.lit(TAILS * WIDE**depth - 1))


@dataclass
class Model:
    """What scoring needs. Its size is bounded by KNOWN, DEEPEST and MOST_ROWS."""

    known: list[bytes]  # commonest first
    count: np.ndarray
    total: int
    distinct: int
    depth: int
    leaf_mass: np.ndarray
    bias: list[np.ndarray]  # of each step: (nodes, branches), logs of shares
    weights: list[np.ndarray]  # of each step: (rows, branches); a node has rows of its own


def start(known: list[bytes], count: np.ndarray, total: int, distinct: int, leaves: np.ndarray) -> Model:
    """The model before training: every branch by its share of counts. leaves: counts and distinct tokens of each leaf of the tail, DIRECT ones left out."""
    depth = depth_of(distinct)
    direct = np.ones(DIRECT)
    direct[: min(DIRECT, len(count))] += count[:DIRECT]
    mass = leaves.sum(axis=0) + 1.0
    levels = [mass.reshape(-1, WIDE)]
    while levels[0].shape[0] > TAILS:
        levels.insert(0, levels[0].sum(axis=1).reshape(-1, WIDE))
    top = np.append(direct, levels[0].sum(axis=1)).reshape(WIDE, WIDE)
    levels = [top.sum(axis=1).reshape(1, WIDE), top, *levels]
    rows = LEAST_ROWS
    while rows < MOST_ROWS and rows * PER_ROW < total:
        rows *= 2
    bias = [np.log(x / x.sum(axis=1, keepdims=True)).astype(np.float32) for x in levels]
    return Model(known, count, total, distinct, depth, mass, bias, [np.zeros((max(rows, len(x)), WIDE), dtype=np.float32) for x in bias])


@dataclass
class Tokens:
    """Tokens of several texts, their ends among them."""

    index: np.ndarray  # among the known, or -1
    hash: np.ndarray
    length: np.ndarray
    words: list[list[bytes]]


def numbers(texts: list[bytes], index: dict[bytes, int]) -> Tokens:
    split = [words_of(t) for t in texts]
    length = np.array([len(w) + 1 for w in split], dtype=np.int64)
    total = int(length.sum())
    own, code = np.empty(total, dtype=np.int32), np.empty(total, dtype=np.uint32)
    end, end_code, at = index.get(END, -1), crc32(END), 0
    for words, n in zip(split, length.tolist(), strict=True):
        own[at : at + n - 1] = np.fromiter(map(index.get, words, repeat(-1)), dtype=np.int32, count=n - 1)
        code[at : at + n - 1] = np.fromiter(map(crc32, words), dtype=np.uint32, count=n - 1)
        own[at + n - 1], code[at + n - 1] = end, end_code
        at += n
    return Tokens(own, code, length, split)


def features(t: Tokens) -> np.ndarray:
    """(tokens, 4) hashes of each token's context."""
    own = t.hash.astype(np.uint64)
    place = np.arange(len(own)) - np.repeat(np.cumsum(t.length) - t.length, t.length)
    before = []
    for k in (1, 2, 3):
        w = np.empty_like(own)
        w[:k] = BEGIN
        w[k:] = own[:-k]
        w[place < k] = BEGIN
        before.append(w)
    one, two, three = before
    f = np.empty((len(own), 4), dtype=np.uint64)
    f[:, 0] = hashed(one, 0)
    f[:, 1] = hashed((one << np.uint64(31)) ^ two, 1)
    f[:, 2] = hashed(two, 2)
    f[:, 3] = hashed(three, 3)
    return f


def steps(m: Model, t_index: np.ndarray, t_hash: np.ndarray) -> Iterator[tuple[np.ndarray | None, np.ndarray, np.ndarray]]:
    """For each step of the paths: places of the tokens that take it (None: all), their node and their branch."""
    tail = (t_index < 0) | (t_index >= DIRECT)
    leaf = t_hash & np.uint32(TAILS * WIDE**m.depth - 1)
    slot = np.where(tail, np.uint32(DIRECT) + (leaf >> np.uint32(4 * m.depth)), t_index.astype(np.uint32)).astype(np.int64)
    yield None, np.zeros(len(slot), dtype=np.int64), slot >> 4
    yield None, slot >> 4, slot & 15
    at = np.flatnonzero(tail)
    low = leaf[at].astype(np.int64)
    for d in range(1, m.depth + 1):
        prefix = low >> (4 * (m.depth - d))
        yield at, prefix >> 4, prefix & 15


def rows_of(m: Model, f: np.ndarray, level: int, node: np.ndarray) -> np.ndarray:
    """Rows of the weights for each token's features."""
    each = (len(m.weights[level]) // len(m.bias[level])).bit_length() - 1
    first = (node << each).astype(np.int32)[:, None]
    if not each:
        return np.broadcast_to(first, f.shape)
    return (((f ^ (node.astype(np.uint64) * MULTIPLIERS[2])[:, None]) * MULTIPLIERS[0]) >> np.uint64(64 - each)).astype(np.int32) + first


def chances(m: Model, rows: np.ndarray, level: int, node: np.ndarray) -> np.ndarray:
    """The chances of a node's branches."""
    x = np.take(m.bias[level], node, axis=0)
    for j in range(rows.shape[1]):
        x += np.take(m.weights[level], rows[:, j], axis=0)
    np.minimum(x, np.float32(60), out=x)  # keeps a runaway weight finite
    np.exp(x, out=x)
    x /= (x @ np.ones(WIDE, dtype=np.float32))[:, None]
    return x


def log10_paths(m: Model, t: Tokens, f: np.ndarray) -> np.ndarray:
    """log10 of the chance of each token's path."""
    out = np.empty(len(t.index))
    for a in range(0, len(out), BATCH):
        g, got = f[a : a + BATCH], np.zeros(min(BATCH, len(out) - a))
        for level, (at, node, branch) in enumerate(steps(m, t.index[a : a + BATCH], t.hash[a : a + BATCH])):
            if not len(node):
                continue
            p = chances(m, rows_of(m, g if at is None else g[at], level, node), level, node)
            logs = np.log10(np.maximum(p[np.arange(len(node)), branch], np.float32(1e-30)))
            if at is None:
                got += logs
            else:
                got[at] += logs
        out[a : a + BATCH] = got
    return out


def add_rows(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """out[rows[i, j]] += values[i] for all i and j."""
    key = np.sort((rows.astype(np.int64) << 20 | np.arange(len(rows))[:, None]).ravel())
    own, token = key >> 20, key & ((1 << 20) - 1)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    n = np.diff(np.append(first, len(own)))
    g = np.take(values, token[first], axis=0)  # most rows are met once in a batch
    many = np.flatnonzero(n > 1)
    if len(many):
        size = n[many]
        g[many] = np.add.reduceat(np.take(values, token[np.repeat(n > 1, n)], axis=0), np.cumsum(size) - size, axis=0)
    out[own[first]] += g


def gradient(m: Model, batches: Iterator[list[bytes]], first: bool) -> Iterator[np.ndarray]:
    """For each step, (rows, 2 * WIDE): observed counts of the branches, and in all rounds but the first the expected ones."""
    index = {w: i for i, w in enumerate(m.known[:DIRECT])}
    seen = [np.zeros(w.size, dtype=np.float32) for w in m.weights]
    ahead = [np.zeros((0 if first else len(w), WIDE), dtype=np.float32) for w in m.weights]
    for texts in batches:
        t = numbers(texts, index)
        f = features(t)
        for a in range(0, len(t.index), BATCH):
            g = f[a : a + BATCH]
            for level, (at, node, branch) in enumerate(steps(m, t.index[a : a + BATCH], t.hash[a : a + BATCH])):
                if not len(node):
                    continue
                rows = rows_of(m, g if at is None else g[at], level, node)
                np.add.at(seen[level], (rows * np.int32(WIDE) + branch[:, None].astype(np.int32)).ravel(), np.float32(1))
                if not first:
                    add_rows(ahead[level], rows, chances(m, rows, level, node))
    while seen:  # a step's sums are let go before the next one's are put together
        s, e = seen.pop(0).reshape(-1, WIDE), ahead.pop(0)
        yield s if first else np.concatenate([s, e], axis=1)


def stepped(weights: np.ndarray, sums: np.ndarray, shares: np.ndarray, first: bool) -> np.ndarray:
    """One scaled step; a token has four features, so a full step by each would go too far."""
    seen = sums[:, :WIDE]
    ahead = seen.sum(axis=1, keepdims=True) * shares if first else sums[:, WIDE:]
    return weights + ((FIRST_RATE if first else RATE) * np.log((seen + PRIOR) / (ahead + PRIOR))).astype(np.float32)


def update(m: Model, level: int, block: int, sums: np.ndarray, first: bool) -> np.ndarray:
    """The weights of a block of rows after a step."""
    at = slice(block * BLOCK, (block + 1) * BLOCK)
    w = m.weights[level][at]
    each = len(m.weights[level]) // len(m.bias[level])
    return stepped(w, sums, np.exp(m.bias[level][(np.arange(at.start, at.start + len(w)) // each)]), first)


SUMS = "level int, block int, rows binary, seen binary, ahead binary"
WEIGHTS = "level int, block int, weights binary"


def packed(values: np.ndarray, short: str) -> bytes:
    """In two bytes a value where all fit (expected counts then keep three digits), else in four."""
    return values.astype(short if values.max(initial=0) < 60_000 else "<f4").tobytes()


def pack(sums: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The rows of a block that were met, their observed and (in all rounds but the first) expected counts."""
    met = np.flatnonzero(sums[:, :WIDE].any(axis=1))
    return met.astype(np.uint8).tobytes(), packed(sums[met, :WIDE], "<u2"), packed(sums[met, WIDE:], "<f2")


def unpack(rows: bytes, seen: bytes, ahead: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    met = np.frombuffer(rows, dtype=np.uint8)
    parts = [np.frombuffer(x, dtype=short if len(x) == 2 * WIDE * len(met) else "<f4").reshape(len(met), WIDE) for x, short in ((seen, "<u2"), (ahead, "<f2"))[: width // WIDE]]
    return met, np.concatenate(parts, axis=1).astype(np.float64)


def one_round(docs: DataFrame, m: Model, first: bool, tasks: int) -> None:
    """A step on these rows; the model's weights change in place."""
    shared = docs.sparkSession.sparkContext.broadcast(m)
    width = WIDE if first else 2 * WIDE

    def table_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * (len(names) - 2)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (byte_column(b, "text") for b in by_bytes(batches, "text", 1 << 20))
        for level, x in enumerate(gradient(shared.value, texts, first)):
            yield table_of([(level, b // BLOCK, *pack(x[b : b + BLOCK])) for b in range(0, len(x), BLOCK) if x[b : b + BLOCK].any()], SUMS)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sums: dict[tuple[int, int], np.ndarray] = {}  # at most the model's blocks
        for batch in batches:
            for level, block, *x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (level, block) not in sums:
                    sums[level, block] = np.zeros((len(m.weights[level][block * BLOCK : (block + 1) * BLOCK]), width))
                met, got = unpack(*x, width)
                sums[level, block][met] += got
        yield table_of([(level, b, update(m, level, b, x, first).tobytes()) for (level, b), x in sums.items()], WEIGHTS)

    got = docs.select("text").coalesce(tasks).mapInArrow(run, SUMS).repartition("level", "block").mapInArrow(step, WEIGHTS).collect()  # the model's blocks
    for r in got:
        m.weights[r.level][r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.weights, dtype=np.float32).reshape(-1, WIDE)
    shared.unpersist()


def threshold(counts: DataFrame, most: int) -> int:
    """Least count such that at most `most` tokens have it or more. Counts are sorted into at most a few hundred bins of their logarithm."""
    grain = 16
    bins = counts.groupBy(F.floor(F.log2("n") * grain).alias("bin")).agg(F.count(F.lit(1)).alias("tokens"), F.min("n").alias("least")).orderBy(F.desc("bin")).collect()
    total, least = 0, None
    for r in bins:
        total += r.tokens
        if total > most:
            break
        least = r.least
    return least if least is not None else 1 << 62


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """(doc_id, text) of all training documents -> the model, and the counts of all tokens (token, n)."""
    counts = materialise(count_tokens(docs))
    total, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    first = counts.orderBy(F.desc("n"), "token").limit(DIRECT).collect()
    common = counts.where(F.col("n") >= threshold(counts, KNOWN)).collect()  # at most KNOWN
    count = {bytes(r.token): r.n for r in [*common, *first]}
    known = sorted(count, key=lambda w: (-count[w], w))
    depth = depth_of(distinct)
    leaves = np.zeros((2, TAILS * WIDE**depth))
    of = counts.where(~F.col("token").isin([bytearray(w) for w in known[:DIRECT]])) if known else counts
    for r in of.groupBy(leaf_column(depth).alias("leaf")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).toLocalIterator():  # at most the leaves
        leaves[:, r.leaf] = r.n, r.d
    m = start(known, np.array([count[w] for w in known], dtype=np.int64), total or 0, distinct, leaves)
    text = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(PARTS)).alias("part"), "text")
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.rdd.getNumPartitions() // 16))
    one_round(text.where(F.col("part") < FIRST), m, True, tasks)
    for part in range(FIRST, PARTS):
        one_round(text.where(F.col("part") == part), m, False, tasks)
    return m, counts


SCORED = "rid binary, doc_id long, n_tokens long, n_known long, n_rare long, base double, model double, rare array<struct<token: binary, n: long>>"


def score(docs: DataFrame, m: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        index = {w: i for i, w in enumerate(m.known)}
        log_count = np.append(np.log10(m.count + 1.0), 0.0)  # -1: rare or unseen, added later
        log_mass = np.log10(m.leaf_mass)
        for batch in by_bytes(batches, "text", 1 << 20):
            texts = byte_column(batch, "text")
            if not texts:
                continue
            t = numbers(texts, index)
            begin = np.cumsum(t.length) - t.length
            own = log_count[t.index]
            in_tail = (t.index < 0) | (t.index >= DIRECT)
            model = log10_paths(m, t, features(t)) + np.where(in_tail, own - log_mass[t.hash & np.uint32(len(log_mass) - 1)], 0.0)
            rare = t.index < 0
            tokens: list[bytes] = []
            times: list[int] = []
            ends = [0]
            for i, words in enumerate(t.words):
                at = np.flatnonzero(rare[begin[i] : begin[i] + t.length[i]])
                # the end token is rare only when nothing was trained
                met = Counter([words[j] if j < len(words) else END for j in at.tolist()])
                tokens += met.keys()
                times += met.values()
                ends.append(len(tokens))
            pairs = pa.StructArray.from_arrays([pa.array(tokens, pa.binary()), pa.array(times, pa.int64())], names=["token", "n"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            sums = [np.add.reduceat(x, begin) for x in (~rare, rare, own, model)]
            yield pa.RecordBatch.from_arrays([
                pa.array([uuid.uuid4().bytes for _ in texts], pa.binary()), batch.column(0), pa.array(t.length), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)),
                pa.array(sums[2]), pa.array(sums[3]), lists,
            ], names=["rid", "doc_id", "n_tokens", "n_known", "n_rare", "base", "model", "rare"])

    rows = materialise(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCORED))
    rare = rows.select("rid", F.explode("rare").alias("r")).select("rid", "r.token", F.col("r.n").alias("times"))
    found = rare.join(counts, "token").groupBy("rid").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("logs"))
    out = rows.drop("rare").join(found, "rid", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(m.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(float(np.log10(m.total + m.distinct + 1)))).alias("base_score"), (F.col("model") + logs).alias("score"),
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = F.coalesce(held_out(F.col("doc_id"), 7, 2), F.lit(False))
    m, counts = fit(docs.where(~out))
    return score(docs, m, counts).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op1_lm_scoring": op1_lm_scoring}
ORACLES: dict[str, str] = {}
