"""Benchmark decontamination by latent semantic retrieval.

Words are lower-cased with marks removed. Document frequencies of the benchmark's terms are counted once, over all
documents. A distributed randomised SVD of the benchmark's TF-IDF passages (16 words, every 4) gives the
latent space: tasks add up their share of A'(A Q) over the passages, the driver only orthonormalises a
(terms x rank) block. Every 16-word window of every document, every 8 words and at the end, that holds a term of the benchmark is
projected and compared with all passages by cosine, tile by tile. A candidate is kept where a span of `SPAN` item lengths near it holds
enough weight of the item's words (without that no verification can succeed, so nothing is lost). Candidates are verified on the
whole item: the longest common subsequence with such a span must hold `SIMILARITY` of the item's words and as
much of their weight (inverse document frequency, so that it isn't made of common words alone), and `ANSWER` of
the answer (the item's last sentence) must be there as well. Items under `SHORT` words say too little for that; they are found
where all their words stand in a row. The benchmark is taken in blocks of bounded size, each against all documents.

Laws for odd input: null, empty or wordless texts and items never match; very long texts are searched whole, tile by tile; ties go to
the first span; a null doc_id is carried through; repeated documents each give their rows; repeated items, or several texts of one item_id,
give one row per document and item_id (the best); items with a null id are left out; an empty table on either side gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscan.llm.common import by_bytes, byte_column, materialise, table

WIDTH, STRIDE = 16, 4
#: Words between windows of a document; passages of an item begin every `STRIDE` words, so that one lies near each window.
STEP = 8
RANK = 96
OVERSAMPLE = 16
POWER = 2
#: Least cosine of a candidate; less for items shorter than a window, by the root of their share of one.
COSINE = 0.77
#: Words of the passages at the beginning and end of items under two windows.
EDGE = 12
#: Least share of an item's words (and their weight) in the common subsequence, and of its answer's; longest span in item lengths.
SIMILARITY, ANSWER, SPAN = 0.5, 0.3, 1.6
#: Items of fewer words are matched word by word.
SHORT = 8
#: Windows, and passages, of a tile of cosines.
TILE = 4096
#: Candidates weighed at a time.
MANY = 500_000
#: Items of a block; a block's terms and passages are what a task holds.
BLOCK_ITEMS = 10_000
FLUSH = 400_000
FEW_TERMS = 1 << 18
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
SENTENCE = re.compile(rb"(?<=[.!?])\s+")


def tokens(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(None, MARKS).split()


def answer_of(text: bytes) -> list[bytes]:
    """The last sentence that holds a word."""
    for part in reversed(SENTENCE.split(text)):
        if words := tokens(part):
            return words
    return []


def lcs(a: list, b: list) -> tuple[int, int]:
    """Length of the longest common subsequence, and where in b its last word first is reached (exclusive)."""
    n = len(a)
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << n) - 1
    v, best, end = full, 0, 0
    for j, w in enumerate(b):
        if m := at.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
            if (got := n - v.bit_count()) > best:
                best, end = got, j + 1
    return best, end


def common(a: list, b: list) -> list:
    """The words of a longest common subsequence (b is a span of bounded length)."""
    table = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(table[-1][j] + 1 if x == y else max(row[-1], table[-1][j + 1]))
        table.append(row)
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif table[i - 1][j] >= table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def windows(lengths: np.ndarray, step: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, first word and end (in the words of all documents together) of every window."""
    count = np.where(lengths > WIDTH, (lengths - WIDTH + step - 1) // step + 1, (lengths > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(lengths)), count)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else count
    k = np.arange(len(doc)) - first[doc]
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    start = np.minimum(k * step, np.maximum(lengths[doc] - WIDTH, 0))
    end = np.minimum(start + WIDTH, lengths[doc])
    return doc, start + begin[doc], end + begin[doc]


def document_frequencies(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(text) documents, (text) items -> (term binary, n long): documents that hold each term of an item; the empty term has the number of documents.

    Up to `FEW_TERMS` terms are sent to the tasks, which count only these; more are joined with counts of all words."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({b"", *(w for t in byte_column(batch, "text") for w in tokens(t))}), pa.binary())], names=["term"])

    wanted = materialise(items.select("text").mapInArrow(terms, "term binary").distinct())
    few = {bytes(r.term) for r in wanted.collect()} if wanted.count() <= FEW_TERMS else None
    shared = docs.sparkSession.sparkContext.broadcast(few)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        few = shared.value

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])
            held.clear()
            return out

        for batch in by_bytes(batches, "text", 2 << 20):
            for text in byte_column(batch, "text"):
                met = set(tokens(text))
                held.update(met if few is None else few & met)
                held[b""] += 1
            if len(held) > FLUSH:
                yield flush()
        yield flush()

    counts = docs.select("text").mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return counts if few is not None else counts.join(wanted, "term")


def randomised_svd(spark: SparkSession, passages: DataFrame, terms: int, rank: int, seed: int = 7) -> np.ndarray:
    """Right singular vectors (terms, rank) of the rows (ids array<int>, weights array<float>) of a sparse matrix."""
    size = min(rank + OVERSAMPLE, terms)
    q = np.random.default_rng(seed).standard_normal((terms, size)).astype(np.float32)
    for _ in range(POWER + 1):
        basis = spark.sparkContext.broadcast(q)

        def project(batches: Iterator[pa.RecordBatch], basis=basis) -> Iterator[pa.RecordBatch]:
            q, out, seen = basis.value, np.zeros((terms, size)), False
            for batch in batches:
                for ids, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    w = np.array(weights, dtype=np.float32)
                    np.add.at(out, ids, np.outer(w, w @ q[ids]))
                    seen = True
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(range(terms), pa.int32()), pa.array(list(out), pa.list_(pa.float64()))], names=["term", "y"])

        parts = passages.mapInArrow(project, "term int, y array<double>")
        got = parts.select("term", F.posexplode("y").alias("j", "y")).groupBy("term", "j").agg(F.sum("y").alias("y")).groupBy("term").agg(F.array_sort(F.collect_list(F.struct("j", "y"))).alias("row")).select("term", "row.y").toArrow()
        y = np.zeros((terms, size))
        if got.num_rows:
            y[got.column("term").to_numpy()] = np.concatenate([c.flatten().to_numpy() for c in got.column("y").chunks]).reshape(-1, size)
        basis.unpersist()
        q = np.linalg.qr(y)[0].astype(np.float32) if terms else y.astype(np.float32)
    return q[:, :rank]


def runs_of(code: np.ndarray, doc: np.ndarray, item: list[int]) -> np.ndarray:
    """Where the item's codes stand in a row in one document. doc: document of each word."""
    if len(code) < len(item):
        return np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(code[: len(code) - len(item) + 1] == item[0])
    for k in range(1, len(item)):
        at = at[code[at + k] == item[k]]
    return at[doc[at] == doc[at + len(item) - 1]]


def holding(code: np.ndarray, weight: np.ndarray, low: np.ndarray, top: np.ndarray, cap: int, least: float) -> np.ndarray:
    """Whether a span of `cap` words inside each stretch [low, top) of words holds the weight `least`."""
    width, a, b = int((top - low).max()), int(low.min()), int(top.max())
    if len(low) * width > b - a:  # they overlap: every span is summed once
        total = np.concatenate([[0], np.cumsum(weight.take(code[a:b]), dtype=np.float64)])
        low, top = low - a, top - a
        good = np.concatenate([[0], np.cumsum(total[cap:] - total[:-cap] >= least)]) if len(total) > cap else np.zeros(1, dtype=np.int64)
        last = np.maximum(top - cap + 1, low)
        return np.where(top - low < cap, total[top] - total[low] >= least, good.take(last, mode="clip") > good.take(low, mode="clip"))
    keep = np.zeros(len(low), dtype=bool)
    for cut in range(0, len(low), max(1, (1 << 20) // width)):
        some = slice(cut, cut + max(1, (1 << 20) // width))
        col = low[some, None] + np.arange(width)
        held = np.where(col < top[some, None], weight.take(code.take(col, mode="clip")), 0).cumsum(axis=1, dtype=np.float32)
        if width > cap:
            most = np.maximum(held[:, cap - 1], (held[:, cap:] - held[:, :-cap]).max(axis=1))
        else:
            most = held[:, -1]
        keep[some] = most >= least
    return keep


class Block:
    """A block of items with their terms, weights and latent passages."""

    def __init__(self, items: list[tuple[int, bytes]]):
        made = [(item, words, answer_of(text)) for item, text in items if (words := tokens(text))]
        self.items = [x for x in made if len(x[1]) >= SHORT]
        self.short = [x for x in made if len(x[1]) < SHORT]
        self.terms = sorted({w for _, words, _ in made for w in words})

    def passages(self) -> tuple[np.ndarray, list[list[int]]]:
        ids = {w: i for i, w in enumerate(self.terms)}
        lengths = np.array([len(w) for _, w, _ in self.items], dtype=np.int64)
        flat = [ids[w] for _, words, _ in self.items for w in words]
        of, start, end = windows(lengths)
        rows = [flat[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        # windows that begin before a short item, or end behind it, hold the item's beginning or end only
        brief = np.flatnonzero((lengths > EDGE) & (lengths < 2 * WIDTH))
        at = np.cumsum(lengths) - lengths
        rows += [flat[a : a + EDGE] for a in at[brief].tolist()] + [flat[b - EDGE : b] for b in (at + lengths)[brief].tolist()]
        return np.concatenate([of, brief, brief]), rows

    def fit(self, spark: SparkSession, n: int, df: dict[bytes, int]) -> None:
        held = np.array([df.get(w, 0) for w in self.terms], dtype=np.int64)
        self.idf = np.log((n + 1) / (held + 1)).astype(np.float32) + np.float32(0.05)
        ids = {w: i + 1 for i, w in enumerate(self.terms)}
        self.weight = {w: float(x) for w, x in zip(self.terms, self.idf, strict=True)}
        self.runs = [[ids[w] for w in words] for _, words, _ in self.short]
        self.bags = [np.array(sorted({ids[w] for w in words}), dtype=np.int32) for _, words, _ in self.items]
        self.heavy = [sum(self.weight[w] for w in words) for _, words, _ in self.items]
        self.sizes = np.array([len(words) for _, words, _ in self.items], dtype=np.int64)
        if not self.items:
            return
        self.of, rows = self.passages()
        made = [([*dict.fromkeys(ids)], [float(self.idf[i]) * ids.count(i) for i in dict.fromkeys(ids)]) for ids in rows]
        frame = spark.createDataFrame(made, "ids array<int>, weights array<float>").repartition(max(1, len(made) // 2000))
        v = randomised_svd(spark, frame, len(self.terms), min(RANK, max(1, len(self.terms))))
        self.vectors = np.concatenate([np.zeros((1, v.shape[1]), dtype=np.float32), v * self.idf[:, None]])
        latent = np.array([self.vectors[np.array(ids) + 1].sum(axis=0) for ids in rows])
        # a window around an item of fewer words than a window holds other words as well, which no cosine of it can make up for
        share = np.sqrt(np.array([min(1.0, self.sizes[k] / WIDTH) for k in self.of]))[:, None]
        self.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True) * share, 1e-9)).astype(np.float32)
        # an item's passages lie together, and in one tile
        order = np.argsort(self.of, kind="stable")
        self.of, self.latent = self.of[order], self.latent[order]
        edge = np.append(np.flatnonzero(np.diff(self.of, prepend=-1)), len(self.of))
        self.tiles: list[np.ndarray] = []
        a = 0
        for i in range(1, len(edge)):
            if i + 1 == len(edge) or edge[i + 1] - edge[a] > TILE:
                self.tiles.append(edge[a : i + 1])
                a = i

    def project(self, code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unit vectors of windows; neighbouring windows share pieces of `STRIDE` words."""
        place, piece = np.unique(start[:, None] + np.arange(0, WIDTH, STRIDE), return_inverse=True)
        piece = piece.reshape(len(start), -1)
        last = np.zeros(len(place), dtype=np.int64)
        last[piece] = end[:, None]  # only a text shorter than a window ends inside one
        own = np.zeros((len(place), self.vectors.shape[1]), dtype=np.float32)
        for k in range(STRIDE):
            own += np.take(self.vectors, np.where(place + k < last, code[np.minimum(place + k, len(code) - 1)], 0), axis=0)
        vec = np.take(own, piece[:, 0], axis=0)
        for k in range(1, WIDTH // STRIDE):
            vec += np.take(own, piece[:, k], axis=0)
        vec /= np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-9)
        return vec

    def promising(self, code: np.ndarray, low: np.ndarray, top: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Of the stretches [low, top) of words, those in which a span of `SPAN` item lengths holds enough weight of the item's words."""
        keep = np.zeros(len(low), dtype=bool)
        mine = np.zeros(len(self.vectors), dtype=np.float32)
        order = np.argsort(item, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(item[order])) + 1):
            k = int(item[part[0]])
            mine[self.bags[k]] = self.idf[self.bags[k] - 1]
            cap, least = int(SPAN * self.sizes[k]) + 1, np.float32(0.999 * SIMILARITY) * self.heavy[k]
            for some in np.split(part, np.flatnonzero(np.diff(low[part] >> 20)) + 1):
                keep[some] = holding(code, mine, low[some], top[some], cap, least)
            mine[self.bags[k]] = 0
        return keep

    def candidates(self, code: np.ndarray, lengths: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int, float]]]:
        """By text and item, (first word, end, cosine) of stretches to verify."""
        doc, start, end = windows(lengths, STEP)
        begin = np.concatenate([[0], np.cumsum(lengths)])
        known = np.concatenate([[0], np.cumsum(code > 0)])
        near = np.flatnonzero(known[end] > known[start])
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        kept: list[tuple[np.ndarray, ...]] = []

        def weigh() -> None:
            """Of what the tiles found, what may hold the item."""
            w, k, value = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if not len(w):
                return
            reach = (SPAN * self.sizes[k]).astype(np.int64) + 1
            low, top = np.maximum(start[w] - reach, begin[doc[w]]), np.minimum(end[w] + reach, begin[doc[w] + 1])
            keep = self.promising(code, low, top, k)
            kept.append((doc[w][keep], k[keep], low[keep], top[keep], value[keep]))

        for at in range(0, len(near), TILE):
            some = near[at : at + TILE]
            vec = self.project(code, start[some], end[some])
            for edge in self.tiles:
                cos = self.latent[edge[0] : edge[-1]] @ vec.T
                best = np.empty((len(edge) - 1, len(some)), dtype=np.float32)  # of each item's passages
                for own, a, b in zip(best, (edge[:-1] - edge[0]).tolist(), (edge[1:] - edge[0]).tolist(), strict=True):
                    cos[a:b].max(axis=0, out=own)
                hit = np.flatnonzero(best >= COSINE)
                k, i = np.divmod(hit, len(some))
                held.append((some[i], self.of[edge[k]], best.ravel()[hit]))
                if sum(len(x[0]) for x in held) > MANY:
                    weigh()
        if held:
            weigh()
        found: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
        for d, m, a, b, c in sorted(x for part in kept for x in zip(*(y.tolist() for y in part), strict=True)):
            own = found.setdefault((d, m), [])
            if own and a <= own[-1][1]:
                own[-1] = (own[-1][0], max(b, own[-1][1]), max(c, own[-1][2]))
            else:
                own.append((a, b, c))
        return found

    def verify(self, k: int, region: list[bytes]) -> tuple[int, float, int, int] | None:
        """Of the spans of the region that hold the item, the best: words in common, share of the answer, first word and end."""
        _, words, answer = self.items[k]
        n, enough = len(words), SIMILARITY * len(words)
        if lcs(words, region)[0] < enough:
            return None
        weight = self.weight
        heavy = SIMILARITY * self.heavy[k]
        own, cap = set(words), int(SPAN * n)
        inside = np.cumsum([0, *(w in own for w in region)])
        best = None
        for p in np.flatnonzero(np.diff(inside)).tolist():  # an alignment begins with a word of the item
            if inside[min(p + cap, len(region))] - inside[p] < enough or best and inside[min(p + cap, len(region))] - inside[p] <= best[0]:
                continue
            got, stop = lcs(words, region[p : p + cap])
            if got < enough or best and got <= best[0]:
                continue
            stop += p
            first = stop - lcs(words[::-1], region[p:stop][::-1])[1]
            told = lcs(answer, region[first:stop])[0]
            if told >= ANSWER * len(answer) and sum(weight[w] for w in common(words, region[first:stop])) >= heavy:
                best = got, told / max(1, len(answer)), first, stop
        return best

    def search(self, texts: list[bytes], ids: dict[bytes, int]) -> list[tuple[int, int, float, float, float, int, int]]:
        """(text number, item_id, cosine, share of the item's words, of its answer's, first word, end) of each leak."""
        split = [tokens(t) for t in texts]
        lengths = np.array([len(w) for w in split], dtype=np.int64)
        if not lengths.sum():
            return []
        get = ids.get
        code = np.concatenate([np.fromiter(map(get, w, repeat(0)), dtype=np.int32, count=len(w)) for w in split])
        begin = np.concatenate([[0], np.cumsum(lengths)]).tolist()
        best: dict[tuple[int, int], tuple] = {}

        def offer(d: int, item: int, row: tuple) -> None:
            if (d, item) not in best or row[1] > best[d, item][1]:
                best[d, item] = row

        if self.short:
            doc = np.repeat(np.arange(len(split)), lengths)
            for (item, words, _), run in zip(self.short, self.runs, strict=True):
                for p in runs_of(code, doc, run).tolist():
                    a = p - begin[doc[p]]
                    offer(int(doc[p]), item, (1.0, 1.0, 1.0, a, a + len(words)))
        for (d, k), regions in sorted(self.candidates(code, lengths).items() if self.items else ()):
            item, words, _ = self.items[k]
            for a, b, cos in regions:
                got = self.verify(k, split[d][a - begin[d] : b - begin[d]])
                if got:
                    offer(d, item, (cos, got[0] / len(words), got[1], a - begin[d] + got[2], a - begin[d] + got[3]))
        return [(d, item, *row) for (d, item), row in sorted(best.items())]


SCHEMA = "item_id long, cosine double, lcs_share double, answer_share double, first_word long, end_word long"


def leaks(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS, key: str = "long") -> DataFrame:
    """One row for every document and benchmark item whose text it holds, verbatim or reworded. key: type of doc_id."""
    spark = docs.sparkSession
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    docs = docs.select(F.col("doc_id").cast(key), F.col("text").cast("string"))
    blocks = max(1, math.ceil(items.count() / block_items))
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    counted = materialise(document_frequencies(docs, items))
    n = counted.where(F.length("term") == 0).select("n").first()
    schema = f"doc_id {key}, {SCHEMA}"
    out = None
    for b in range(blocks):
        rows = items.where(of == b).orderBy("item_id", "text").collect()  # some `block_items`
        block = Block([(r.item_id, r.text.encode()) for r in rows])
        if not block.terms:
            continue
        terms = spark.createDataFrame([(bytearray(w),) for w in block.terms], "term binary")
        block.fit(spark, n.n if n else 0, {bytes(r.term): r.n for r in counted.join(F.broadcast(terms), "term").collect()})  # a block's terms
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            ids = {w: i + 1 for i, w in enumerate(block.terms)}
            for batch in by_bytes(batches, "text", 4 << 20):
                found = block.search(byte_column(batch, "text"), ids)
                own = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                kinds = [pa.int64(), *[pa.float64()] * 3, pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([own, *(pa.array([f[i + 1] for f in found], t) for i, t in enumerate(kinds))], names=["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))])

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    if blocks == 1:
        return out
    # texts of one item_id may lie in several blocks; a row without a doc_id is its own
    best = F.max_by(F.struct("cosine", "lcs_share", "answer_share", "first_word", "end_word"), F.struct("lcs_share", -F.col("first_word"))).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLES: dict[str, str] = {}
