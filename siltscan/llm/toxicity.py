"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own vector (words of the training sample; others share one) beside the mean of its hashed
character four-grams' vectors. Windows of 32 words, every 16 and at the end, run through one recurrent network each way; attention
pools the states, a linear layer scores the window, and a text scores as its worst window. Labels mark whole documents, so training
repeats two steps: pick the worst window of each toxic document (first by word log-odds, then by the network), and
descend on those against windows of clean documents. At last scores are moved so that 0.7 is the best cut on the sample.

Laws for odd input: null, empty or wordless texts score as `EMPTY`; one-word texts are one short window; without labels of both kinds
every text scores as `EMPTY`; repeated rows score alike; a document labelled twice counts once (toxic wins); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscan.llm.common import by_bytes, byte_column, held_out, table

WIDTH, STRIDE = 32, 16
HIDDEN, WORD, CHAR = 8, 8, 8
GRAMS = 1 << 15
LEAST_DF = 5
#: Labelled documents the network is fitted on, at most: toxic and clean (lowest xxhash64 of the id first).
FIT_TOXIC, FIT_CLEAN = 1500, 2500
EPOCHS, BATCH, RATE = 8, 128, 0.01
#: Small samples are gone through more often, to this many steps.
LEAST_STEPS = 500
DECAY = 1e-4
EMPTY = 0.01
CUT = 0.7
#: ASCII other than letters becomes a space; upper case becomes lower case.
FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def tokens(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(FOLD).split()


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and words of each window over all documents' words together."""
    count = np.where(lengths > WIDTH, (lengths - WIDTH + STRIDE - 1) // STRIDE + 1, (lengths > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(lengths)), count)
    k = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    start = np.minimum(k * STRIDE, np.maximum(lengths[doc] - WIDTH, 0))
    return doc, start + (np.cumsum(lengths) - lengths)[doc], np.minimum(lengths[doc], WIDTH)


def char_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the four-grams of ^word$, and how many each word has."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    text = np.frombuffer(b"^" + b"$^".join(words) + b"$   ", dtype=np.uint8).astype(np.uint32)
    code = text[:-3] | text[1:-2] << np.uint32(8) | text[2:-1] << np.uint32(16) | text[3:] << np.uint32(24)
    end = np.repeat(np.cumsum(size), size)
    first = np.repeat(np.cumsum(size) - size, size)
    at = np.arange(len(end))
    keep = (at + 4 <= end) | (at == first)  # shorter words give one gram
    bucket = (code[: len(end)][keep] * np.uint32(2654435761)) >> np.uint32(32 - 15)
    return bucket.astype(np.int64), np.maximum(size - 3, 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


class Network:
    def __init__(self, vocabulary: list[bytes], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.ids = {w: i + 1 for i, w in enumerate(vocabulary)}

        def draw(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "word": draw(len(vocabulary) + 1, WORD, scale=0.1), "char": draw(GRAMS, CHAR, scale=0.1),
            "x": draw(2, WORD + CHAR, 3 * HIDDEN, scale=0.25), "bias": np.zeros((2, 1, 3 * HIDDEN), dtype=np.float32), "h": draw(2, HIDDEN, 3 * HIDDEN, scale=0.25),
            "attend": draw(2 * HIDDEN, scale=0.25), "out": draw(2 * HIDDEN, scale=0.25), "out0": np.zeros(1, dtype=np.float32),
        }
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input vector of each distinct word, with what it is made of."""
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), dtype=np.int64, count=len(words))
        grams, size = char_grams(words)
        chars = np.add.reduceat(self.p["char"][grams], np.cumsum(size) - size) / size[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][ids], chars], axis=1), ids, grams, size

    def forward(self, own: np.ndarray, index: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """Logits of windows. own: (2, words, 3 * HIDDEN) projections, index: (n, width) words, mask: (n, width) or None."""
        n, width = index.shape
        h = np.zeros((2, n, HIDDEN), dtype=np.float32)
        states = np.empty((2, width, n, HIDDEN), dtype=np.float32)
        u = self.p["h"]
        for t in range(width):
            x = np.stack([own[0][index[:, t]], own[1][index[:, width - 1 - t]]])
            g = np.matmul(h, u)
            zr = sigmoid(x[..., : 2 * HIDDEN] + g[..., : 2 * HIDDEN])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            new = np.tanh(x[..., 2 * HIDDEN :] + r * g[..., 2 * HIDDEN :])
            after = new + z * (h - new)
            if mask is not None:
                m = np.stack([mask[:, t], mask[:, width - 1 - t]])[..., None]
                after = m * after + (1 - m) * h
            if keep is not None:
                keep.append((h, z, r, new, g[..., 2 * HIDDEN :]))
            h = after
            states[0, t], states[1, width - 1 - t] = h[0], h[1]
        a = states[0] @ self.p["attend"][:HIDDEN] + states[1] @ self.p["attend"][HIDDEN:]
        if mask is not None:
            a = np.where(mask.T > 0, a, np.float32(-1e9))
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.concatenate([(a[..., None] * s).sum(axis=0) for s in states], axis=1)
        if keep is not None:
            keep += [states, a, pooled]
        return pooled @ self.p["out"] + self.p["out0"][0]

    def gradients(self, words: list[bytes], index: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss."""
        p = self.p
        n, width = index.shape
        vec, ids, grams, size = self.inputs(words)
        own = np.matmul(vec, p["x"]) + p["bias"]
        keep: list = []
        logit = self.forward(own, index, mask, keep)
        states, a, pooled = keep[-3:]
        d = ((sigmoid(logit) - y) / n).astype(np.float32)
        out = {"out": pooled.T @ d, "out0": np.array([d.sum()], dtype=np.float32)}
        dp = d[:, None] * p["out"]
        both = np.concatenate([states[0], states[1]], axis=2)
        da = (both * dp).sum(axis=2)
        ds = a * (da - (a * da).sum(axis=0))
        out["attend"] = np.einsum("tn,tnk->k", ds, both)
        dstate = a[..., None] * dp + ds[..., None] * p["attend"]
        dstate = np.stack([dstate[..., :HIDDEN], dstate[..., HIDDEN:]])
        dh = np.zeros((2, n, HIDDEN), dtype=np.float32)
        out["h"] = np.zeros_like(p["h"])
        down = np.zeros_like(own)
        for t in range(width - 1, -1, -1):
            h, z, r, new, gn = keep[t]
            dh = dh + np.stack([dstate[0, t], dstate[1, width - 1 - t]])
            m = np.stack([mask[:, t], mask[:, width - 1 - t]])[..., None]
            now = dh * m
            dn = now * (1 - z) * (1 - new * new)
            dz = now * (h - new) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            g = np.concatenate([dz, dr, dn * r], axis=2)
            out["h"] += np.matmul(h.transpose(0, 2, 1), g)
            x = np.concatenate([dz, dr, dn], axis=2)
            np.add.at(down[0], index[:, t], x[0])
            np.add.at(down[1], index[:, width - 1 - t], x[1])
            dh = dh * (1 - m) + now * z + np.matmul(g, p["h"].transpose(0, 2, 1))
        out["x"] = np.matmul(vec.T, down)
        out["bias"] = down.sum(axis=1, keepdims=True)
        dv = np.matmul(down, p["x"].transpose(0, 2, 1)).sum(axis=0)
        out["word"], out["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(out["word"], ids, dv[:, :WORD])
        np.add.at(out["char"], grams, np.repeat(dv[:, WORD:] / size[:, None], size, axis=0))
        return out

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
        """Logits of all windows, their documents, and the word numbers they were made of."""
        split = [tokens(t) for t in texts]
        lengths = np.array([len(w) for w in split], dtype=np.int64)
        doc, start, count = windows(lengths)
        number: dict[bytes, int] = {}
        flat = np.array([number.setdefault(w, len(number)) for words in split for w in words], dtype=np.int64)
        words = list(number)
        logit = np.zeros(len(doc), dtype=np.float32)
        if len(doc):
            own = np.matmul(self.inputs(words)[0], self.p["x"]) + self.p["bias"]
            for full in (True, False):
                rows = np.flatnonzero((count == WIDTH) == full)
                for at in range(0, len(rows), 4096):
                    some = rows[at : at + 4096]
                    index, mask = place(flat, start[some], count[some])
                    logit[some] = self.forward(own, index, None if full else mask)
        return logit, doc, start, (words, flat, count)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The worst window's score of each text."""
        logit, doc, _, _ = self.texts(texts)
        out = np.full(len(texts), EMPTY)
        if len(doc):
            own, first = np.unique(doc, return_index=True)
            out[own] = 1 / (1 + np.exp(-(self.scale * np.maximum.reduceat(logit.astype(np.float64), first) + self.shift)))
        return out


def place(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    col = np.arange(WIDTH)[None]
    mask = col < count[:, None]
    return flat[np.minimum(start[:, None] + col, len(flat) - 1)], mask.astype(np.float32)


def fit(toxic: list[bytes], clean: list[bytes], seed: int = 5) -> Network | None:
    if not toxic or not clean:
        return None
    rng = np.random.default_rng(seed)
    texts = toxic + clean
    df: dict[bytes, int] = {}
    bad: dict[bytes, int] = {}
    for i, t in enumerate(texts):
        for w in set(tokens(t)):
            df[w] = df.get(w, 0) + 1
            bad[w] = bad.get(w, 0) + (i < len(toxic))
    net = Network(sorted(w for w, n in df.items() if n >= LEAST_DF), seed)
    odds = {w: np.log((bad[w] + 0.1) / len(toxic)) - np.log((df[w] - bad[w] + 0.5) / len(clean)) for w in df}
    _, doc, start, (words, flat, count) = net.texts(texts)
    if not len(doc):
        return None
    by_word = np.array([odds[w] for w in words])
    index, mask = place(flat, start, count)
    value = np.where(mask > 0, by_word[index], -np.inf).max(axis=1)
    positive = doc < len(toxic)
    m = {k: np.zeros_like(x) for k, x in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step = 0
    each = 2 * len(toxic) + 3 * len(clean)  # windows of an epoch, about
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // each))
    for epoch in range(epochs):
        done = epoch / epochs
        if done >= 0.375:
            own = np.matmul(net.inputs(words)[0], net.p["x"]) + net.p["bias"]
            value = np.concatenate([net.forward(own, index[a : a + 4096], mask[a : a + 4096]) for a in range(0, len(index), 4096)])
        order = np.lexsort((value, doc))
        last = order[np.append(np.flatnonzero(doc[order][1:] != doc[order][:-1]), len(order) - 1)]
        worst_bad, worst_good = last[positive[last]], last[~positive[last]]
        others = rng.choice(np.flatnonzero(~positive), size=min(int((~positive).sum()), 2 * len(worst_good)), replace=False)
        rows = np.concatenate([worst_bad, worst_bad, worst_good, others])
        rng.shuffle(rows)
        for at in range(0, len(rows), BATCH):
            some = rows[at : at + BATCH]
            used, local = np.unique(index[some], return_inverse=True)
            grad = net.gradients([words[i] for i in used], local.reshape(index[some].shape), mask[some], positive[some].astype(np.float32))
            step += 1
            for k, g in grad.items():
                g = g + np.float32(DECAY) * net.p[k]
                m[k] += np.float32(0.1) * (g - m[k])
                v[k] += np.float32(0.01) * (g * g - v[k])
                net.p[k] -= np.float32(RATE / (1 + 0.8 * done)) * (m[k] / np.float32(1 - 0.9**step)) / (np.sqrt(v[k] / np.float32(1 - 0.99**step)) + np.float32(1e-6))
    logit, doc, _, _ = net.texts(texts)
    own, first = np.unique(doc, return_index=True)
    top = np.maximum.reduceat(logit.astype(np.float64), first)
    truth = own < len(toxic)
    order = np.argsort(-top, kind="stable")
    hit = np.cumsum(truth[order])
    f1 = 2 * hit / (np.arange(1, len(order) + 1) + truth.sum())
    k = int(f1.argmax())
    cut = (top[order[k]] + top[order[min(k + 1, len(order) - 1)]]) / 2
    net.shift = float(np.log(CUT / (1 - CUT)) - net.scale * cut)
    return net


def train(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = (FIT_TOXIC, FIT_CLEAN)) -> Network | None:
    """Fit on at most `most` toxic and clean documents of the given labels."""
    one = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [one.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for t, n in ((1, most[0]), (0, most[1]))]
    rows = docs.select("doc_id", "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id").collect()  # bounded by `most`
    rows.sort(key=lambda r: (r.doc_id, r.text or ""))
    return fit([(r.text or "").encode() for r in rows if r.toxic], [(r.text or "").encode() for r in rows if not r.toxic])


def score(docs: DataFrame, net: Network | None, carry: str = "doc_id long") -> DataFrame:
    names = [c.split()[0] for c in carry.split(", ")]
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in by_bytes(batches, "text", 2 << 20):
            texts = byte_column(batch, "text")
            got = net.score(texts) if net else np.full(len(texts), EMPTY)
            own = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(got)], names=[*names, "score"])

    return docs.mapInArrow(run, f"{carry}, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = F.coalesce(held_out(F.col("doc_id"), 3, 1), F.lit(False))
    net = train(docs, table(spark, sf_dir, "labels").where(~out))
    return score(docs, net).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
