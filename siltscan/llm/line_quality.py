"""Quality rules: base counts, and a linear-chain CRF that labels lines content or boilerplate.

Every line that holds a word is an observation. Line features are bucketed ratios (symbols, upper case,
table bars, repeated words, repeats of other lines, marks). The chain has two labels; unary weights
and transitions are trained here from labels.quality: a document's lines first all take its label, then
training alternates with Viterbi labelling in which a low-quality document keeps at least its worst
line as boilerplate. The share of a document's words that lie on content lines decides retention.

Laws for odd input: a null or empty text, or one without words, has zero counts, fails the base rule and is
not kept; empty lines are not observations; an unlabelled or empty label table leaves the hand-set prior
weights; a null doc_id is judged and never fitted on; a very long text is one batch (its lines are held together, as its chain is one);
equal scores of both labels read as content; repeated rows are judged alike, one result row each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscan.llm.common import SPACE, by_bytes, byte_column, table

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Labelled documents the CRF is fitted on, at most (lowest xxhash64 of the id first).
FIT_DOCS = 3000
#: Least share of words on content lines that keeps a document.
CONTENT_SHARE = 0.5
UPPER = bytes(range(65, 91))
NOT_UPPER = bytes(x for x in range(256) if not 65 <= x <= 90)
LOWER_ONLY = bytes(x for x in range(256) if not 97 <= x <= 122)
FEATURES = 8
#: Prior of the unary weights (boilerplate minus content): symbols, upper, bars, repeats, same line, marks, short, bias.
PRIOR = np.array([6.0, 5.0, 6.0, 6.0, 0.5, 4.0, 0.2, -3.0])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words that occurs twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.array(list(map(hash, words)), dtype=np.int64).view(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for i in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + (h[i : i + n] ^ (h[i : i + n] >> np.uint64(29)))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + window, dtype=np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    np.subtract.at(edge, at + window, 1)
    return int((np.cumsum(edge)[: len(words)] > 0).sum())


def line_features(line: bytes, words: list[bytes], seen_before: bool) -> tuple[float, ...]:
    n, size = len(words), max(1, len(line))
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    upper = len(line.translate(None, NOT_UPPER))
    lower = len(line.translate(None, LOWER_ONLY))
    bars = words.count(b"|")
    distinct = len(set(words))
    return (
        min(1.0, 8.0 * symbols / size),
        upper / (upper + lower) if upper + lower > 3 and upper > n else 0.0,
        min(1.0, 3.0 * bars / n),
        1.0 if n >= 4 and 2 * distinct < n else max(0.0, 1.0 - distinct / n - 0.3) if n >= 4 else 0.0,
        float(seen_before),
        min(1.0, 2.0 * line.count(b"!!") / n),
        float(n < 4),
        1.0,
    )


def describe(text: bytes) -> tuple[int, int, int, int, int, list[tuple[float, ...]], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, features and word counts of the lines."""
    words = text.split()
    inside = text.translate(None, SPACE)
    chars = len(inside.decode("utf-8", "replace")) if inside else 0
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup, feats, sizes = 0, [], []
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            continue
        again = line in seen
        dup += again
        seen.add(line)
        feats.append(line_features(line, own, again))
        sizes.append(len(own))
    return len(words), chars, symbols, dup, repeated_words(words), feats, sizes


def viterbi(unary: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels of many two-label chains at once. unary: (lines, 2), documents one after another."""
    out = np.zeros(len(unary), dtype=np.int8)
    if not len(unary):
        return out
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    live = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")  # chains with more than t lines
    back = np.zeros((len(unary), 2), dtype=np.int8)
    score = unary[starts[: live[0]]].copy()
    final = np.zeros((len(lengths), 2))
    for t in range(1, int(lengths[0])):
        m = live[t]
        final[m : live[t - 1]] = score[m:]
        cand = score[:m, :, None] + trans[None]
        best = cand.argmax(axis=1)
        at = starts[:m] + t
        back[at] = best
        score = np.take_along_axis(cand, best[:, None, :], axis=1)[:, 0] + unary[at]
    final[: len(score)] = score
    label = final.argmax(axis=1).astype(np.int8)
    for t in range(int(lengths[0]) - 1, -1, -1):
        m = live[t]
        at = starts[:m] + t
        out[at] = label[:m]
        label[:m] = back[at, label[:m]]
    return out


def _marginals(unary: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node and edge marginals of one chain."""
    n = len(unary)
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    a[0] = unary[0]
    for t in range(1, n):
        a[t] = unary[t] + np.logaddexp(a[t - 1, 0] + trans[0], a[t - 1, 1] + trans[1])
    for t in range(n - 2, -1, -1):
        x = unary[t + 1] + b[t + 1]
        b[t] = np.logaddexp(trans[:, 0] + x[0], trans[:, 1] + x[1])
    z = np.logaddexp(*a[-1])
    node = np.exp(a + b - z)
    edge = np.exp(a[:-1, :, None] + trans[None] + (unary[1:] + b[1:])[:, None, :] - z).sum(axis=0) if n > 1 else np.zeros((2, 2))
    return node, edge


def fit_crf(docs: list[tuple[np.ndarray, int]], rounds: int = 3, steps: int = 15) -> dict[str, np.ndarray]:
    """docs: (features of the lines, quality). Returns unary weights (features, 2) and transitions (2, 2)."""
    w = np.stack([np.zeros(FEATURES), PRIOR], axis=1)
    trans = np.array([[0.6, -0.6], [-0.6, 0.6]])
    docs = [(x, q) for x, q in docs if len(x)]
    if not any(q for _, q in docs) or all(q for _, q in docs):
        return {"w": w, "trans": trans}
    prior_w, prior_t = w.copy(), trans.copy()
    for _ in range(rounds):
        targets = []
        for x, q in docs:
            u = x @ w
            y = np.zeros(len(x), dtype=np.int8) if q else viterbi(u, np.array([len(x)]), trans)
            if not q and not y.any():
                y[int(np.argmax(u[:, 1] - u[:, 0]))] = 1
            targets.append(y)
        for _ in range(steps):
            gw, gt, n = np.zeros_like(w), np.zeros_like(trans), 0
            for (x, _), y in zip(docs, targets, strict=True):
                node, edge = _marginals(x @ w, trans)
                gold = np.eye(2)[y]
                gw += x.T @ (gold - node)
                if len(y) > 1:
                    np.add.at(gt, (y[:-1], y[1:]), 1.0)
                    gt -= edge
                n += len(y)
            w += 4.0 * gw / n - 0.02 * (w - prior_w)
            trans += 1.0 * gt / n - 0.02 * (trans - prior_t)
    return {"w": w, "trans": trans}


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> dict[str, np.ndarray]:
    """Fit on at most `fit_docs` labelled documents, of rows of one id on the least text. What the driver gathers is bounded by that parameter, not by the tables."""
    some = labels.where("quality is not null").select("doc_id", "quality").dropDuplicates(["doc_id"])
    low = some.where("quality = 0").orderBy(F.xxhash64("doc_id")).limit(fit_docs // 2)
    high = some.where("quality = 1").orderBy(F.xxhash64("doc_id")).limit(fit_docs // 2)
    chosen = low.unionByName(high)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(describe(text)[5], dtype=np.float64).tobytes() for text in byte_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], names=["doc_id", "quality", "x"])

    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    met = met.groupBy("doc_id").agg(F.min("text").alias("text"), F.min(F.col("quality").cast("int")).alias("quality"))
    got = met.mapInArrow(lines, "doc_id long, quality int, x binary").collect()  # numbers as bytes: as Python's they take four times as much
    got.sort(key=lambda r: r.doc_id)
    return fit_crf([(np.array(memoryview(r.x)).view(np.float64).reshape(-1, FEATURES), r.quality) for r in got])


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def label_lines(text: str, model: dict[str, np.ndarray]) -> list[str]:
    """The label of every line that holds a word."""
    feats = describe(text.encode())[5]
    if not feats:
        return []
    x = np.array(feats)
    return ["boilerplate" if y else "content" for y in viterbi(x @ model["w"], np.array([len(x)]), model["trans"])]


def judge(docs: DataFrame, model: dict[str, np.ndarray], carry: str = "doc_id long") -> DataFrame:
    """The counts and verdict of every row; `carry` names and types the columns to keep beside `text`."""
    names = [c.split()[0] for c in carry.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 8 << 20):
            found = [describe(text) for text in byte_column(batch, "text")]
            lengths = np.array([len(x[5]) for x in found], dtype=np.int64)
            share = np.zeros(len(found))
            if lengths.sum():
                x = np.array([f for d in found for f in d[5]])
                size = np.array([n for d in found for n in d[6]], dtype=np.float64)
                has = lengths > 0
                y = viterbi(x @ model["w"], lengths[has], model["trans"])
                first = np.concatenate([[0], np.cumsum(lengths[has])[:-1]])
                share[has] = np.add.reduceat(size * (y == 0), first) / np.add.reduceat(size, first)
            count = np.array([d[:5] for d in found], dtype=np.int64).reshape(-1, 5)
            failed = (count[:, 0] < 20) | (100 * count[:, 4] > 30 * count[:, 0])
            kept = ~failed & (share >= CONTENT_SHARE)
            own = [batch.column(batch.schema.get_field_index(c)) for c in names]
            made = [*(pa.array(count[:, i]) for i in range(5)), pa.array(failed), pa.array(kept), pa.array(share)]
            yield pa.RecordBatch.from_arrays([*own, *made], names=[*names, *(c.split()[0] for c in RESULT.split(", "))])

    return docs.mapInArrow(run, f"{carry}, {RESULT}")


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op7_line_quality": op7_line_quality}
ORACLES: dict[str, str] = {}
