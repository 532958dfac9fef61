"""Language of a document by multilingual mixture inference.

Letters are lower-cased, everything else in ASCII becomes a space, and byte trigrams are hashed to buckets.
Training sums trigram counts per language over all training documents (partial sums per task, then, one row at a
time, sums of some tasks' blocks of buckets and sums of these). For a document, expectation-maximisation estimates the proportions of the languages
that mix to its trigrams; nested sets of its likeliest languages, of every size until the penalised likelihood falls, are refitted and
the set with the best one is selected; the largest proportion in that set gives the label.

Laws for odd input: `und` with score 0 for a null text or one without letters; with no training row at all every text
is `und`; a row with a null doc_id counts as a training row; a very long text is a batch of its own; an empty table gives an empty result; equal proportions go to the language first in sort order; repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscan.llm.common import by_bytes, held_out, table

BUCKETS = 1 << 15
BLOCK = 1 << 12
#: Partial sums of a block meet in so many tasks before they meet in one.
SPREAD = 32
ROUNDS = 12
#: Penalty of each further language: half the log of the trigram count, and this share of it (trigrams of a text depend on each other).
PER_GRAM = 0.01
TO_SPACE = bytes(x if x >= 128 or 97 <= x <= 122 else 32 for x in range(256))
LETTER = re.compile(r"[^\W\d_]")


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, bucket) pairs in order, with counts, and the number of trigrams of each document."""
    parts = [t.lower().encode("utf-8", "surrogatepass").translate(TO_SPACE) for t in texts]
    sizes = np.array([len(p) + 3 for p in parts], dtype=np.int64)
    text = np.frombuffer(b" " + b"   ".join(parts) + b"   ", dtype=np.uint8)
    a, b, c = text[:-2], text[1:-1], text[2:]
    keep = b != 32
    code = (a.astype(np.uint32) | (b.astype(np.uint32) << np.uint32(8)) | (c.astype(np.uint32) << np.uint32(16)))[keep]
    code *= np.uint32(2654435761)
    bucket = code >> np.uint32(32 - 15)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint32), sizes)[: len(keep)][keep]
    key = doc * np.uint32(BUCKETS) + bucket
    key.sort()
    if not len(key):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, np.zeros(len(texts), dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key)))
    own = key[first]
    docs = (own // np.uint32(BUCKETS)).astype(np.int64)
    return docs, (own % np.uint32(BUCKETS)).astype(np.int64), count, np.bincount(docs, weights=count, minlength=len(texts)).astype(np.int64)


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(text, lang) rows -> languages in sort order and natural log probabilities (languages, buckets)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in by_bytes(batches, "text", 4 << 20):
            langs = batch.column(1).to_pylist()
            doc, bucket, n, _ = grams([x or "" for x in batch.column(0).to_pylist()])
            names = sorted(set(langs))
            at = np.array([names.index(x) for x in langs])
            got = np.bincount(at[doc] * BUCKETS + bucket, weights=n, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS) if len(doc) else np.zeros((len(names), BUCKETS))
            for name, x in zip(names, got, strict=True):
                sums[name] = sums[name] + x if name in sums else x
        for name, x in sums.items():
            blocks = x.astype(np.int64).reshape(-1, BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(blocks)), pa.array(range(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], names=["lang", "block", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}  # at most the languages' blocks
        for batch in batches:
            for lang, block, n in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("lang", "block", "n")), strict=True):
                got = np.frombuffer(n, dtype=np.int64)
                sums[lang, block] = sums[lang, block] + got if (lang, block) in sums else got
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["lang", "block", "n"])

    schema = "lang string, block int, n binary"
    some = docs.select("text", "lang").mapInArrow(count, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
    got = some.repartition("lang", "block", "salt").mapInArrow(add, schema).repartition("lang", "block").mapInArrow(add, schema).collect()  # the languages' blocks
    langs = sorted({r.lang for r in got})
    table_ = np.zeros((len(langs), BUCKETS))
    for r in got:
        table_[langs.index(r.lang), r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.n, dtype=np.int64)
    return langs, np.log((table_ + 0.1) / (table_ + 0.1).sum(axis=1, keepdims=True))


def _fit(p: np.ndarray, n: np.ndarray, starts: np.ndarray, length: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation of each document's proportions; entries of a document lie together."""
    total = np.add.reduceat(n, starts)[:, None]
    for _ in range(rounds):
        r = p * np.repeat(share, length, axis=0)
        r *= (n / np.maximum(r.sum(axis=1), 1e-30))[:, None]
        share = (np.add.reduceat(r, starts, axis=0) / total).astype(np.float32)
    s = (p * np.repeat(share, length, axis=0)).sum(axis=1)
    return share, np.add.reduceat(n * np.log(np.maximum(s, 1e-30)), starts)


def infer(texts: list[str | None], langs: list[str], logp: np.ndarray) -> tuple[list[str], np.ndarray, list[list[str]]]:
    """Label, its proportion, and the selected language set of each text."""
    label, score, chosen = ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
    has = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if langs else []
    if not has:
        return label, score, chosen
    doc, bucket, count, _ = grams([texts[i] for i in has])
    if not len(doc):
        return label, score, chosen
    present, starts, length = np.unique(doc, return_index=True, return_counts=True)
    n = count.astype(np.float32)
    p = np.exp(logp.T.astype(np.float32))[bucket] * np.float32(1e3)
    k = len(langs)
    share, _ = _fit(p, n, starts, length, np.full((len(present), k), 1.0 / k, dtype=np.float32), ROUNDS)
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
    size = np.add.reduceat(n, starts)
    best, best_share = np.full(len(present), -np.inf), share
    value = best
    for m in range(1, k + 1):
        some = np.where(rank < m, share + np.float32(1e-6), 0).astype(np.float32)
        some /= some.sum(axis=1, keepdims=True)
        some, ll = _fit(p, n, starts, length, some, 4 if m > 1 else 0)
        last, value = value, ll - m * (0.5 * np.log(size + 1) + PER_GRAM * size)
        if not (value > last).any():
            break
        better = value > best
        best = np.where(better, value, best)
        best_share = np.where(better[:, None], some, best_share)
    top = best_share.argmax(axis=1)
    for j, d in enumerate(present):
        i = has[d]
        label[i], score[i] = langs[top[j]], min(1.0, float(best_share[j, top[j]]))
        chosen[i] = [langs[x] for x in np.flatnonzero(best_share[j] > 0)]
    return label, score, chosen


def identify(docs: DataFrame, langs: list[str], logp: np.ndarray, carry: str = "doc_id long") -> DataFrame:
    names = [c.split()[0] for c in carry.split(", ")]
    shared = docs.sparkSession.sparkContext.broadcast(logp.astype(np.float32))
    most = max(1 << 16, (16 << 20) // max(4, len(langs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", most):
            label, score, chosen = infer(batch.column(batch.schema.get_field_index("text")).to_pylist(), langs, shared.value)
            own = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(label, pa.string()), pa.array(score), pa.array(chosen, pa.list_(pa.string()))], names=[*names, "lang_pred", "score", "languages"])

    return docs.mapInArrow(run, f"{carry}, lang_pred string, score double, languages array<string>")


def op9_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    out = F.coalesce(held_out(F.col("doc_id"), 4, 2), F.lit(False))
    langs, logp = train(docs.where(~out & F.col("lang").isNotNull()).select("text", "lang"))
    return identify(docs.select("doc_id", "text"), langs, logp).select("doc_id", out.alias("held_out"), "lang_pred", "score", "languages")


QUERIES = {"op9_language_mix": op9_language_mix}
ORACLES: dict[str, str] = {}
