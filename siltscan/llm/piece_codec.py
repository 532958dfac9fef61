"""SentencePiece BPE encoding with seeded merge dropout, and lossless decoding.

The vocabulary file's path is a parameter; each worker opens it once. A text (with the dummy prefix space) is cut before
spaces that follow other characters and around line ends, where no piece of the vocabulary can lie (checked when it is opened).
Inside a chunk the agenda always takes the best-scored adjacent pair, leftmost first; a candidate merge
(start, piece) is skipped when a hash keyed by seed, document, position of the chunk and its text falls under the dropout rate, so every
occurrence of a word draws its own segmentation. Many chunks are segmented together in numpy; chunks beyond
`LONG` characters use a heap agenda, which gives the same result. Characters outside the vocabulary fall back to bytes.

Laws for odd input: null and empty texts have no pieces and decode to the empty text; a very long text is a batch of its own; an empty table gives an empty result; a literal U+2581 is spelt in bytes,
so that it doesn't decode to a space; a null doc_id counts as 0; repeated rows are encoded alike; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscan.llm.common import by_bytes, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 42
LONG = 48
NEVER = np.iinfo(np.int32).max
CHUNK = re.compile(r" *[^ \n\t]+| +|[\n\t]")
SLOTS = 21
M64 = (1 << 64) - 1
C1, C2, C3 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(C2)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(C3)
    return x ^ (x >> np.uint64(31))


def mix_int(x: int) -> int:
    x &= M64
    x = ((x ^ (x >> 30)) * C2) & M64
    x = ((x ^ (x >> 27)) * C3) & M64
    return x ^ (x >> 31)


class Vocabulary:
    """Pieces, ranks and the table of pairs that merge."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = sp.get_piece_size()
        pieces = sp.id_to_piece(list(range(n)))
        normal = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        spelt = {p.replace("▁", " "): i for i, p in enumerate(pieces) if normal[i]}
        if any(" " in p.lstrip(" ") or "\n" in p or "\t" in p for p in spelt):
            raise ValueError("pieces that span words or lines are not supported")
        self.unknown = sp.unk_id()
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        self.bytes_of = [b""] * n
        for p, i in spelt.items():
            self.bytes_of[i] = p.encode()
        for b, i in enumerate(self.byte):
            self.bytes_of[i] = bytes([b])
        lengths = np.array([len(x) for x in self.bytes_of], dtype=np.int64)
        self.byte_start, self.byte_length = np.cumsum(lengths) - lengths, lengths
        self.byte_flat = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.char = np.arange(0x110000, dtype=np.int32) + n  # ids from n on: characters outside the vocabulary
        for p, i in spelt.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[0x2581] = n + 0x2581
        score = np.array(sp.get_score(list(range(n))), dtype=np.float64)
        order = np.argsort(-score, kind="stable")
        self.rank = np.empty(n, dtype=np.int32)
        self.rank[order] = np.arange(n, dtype=np.int32)
        self.of_rank = order.astype(np.int32)
        self.pairs = {}
        for p, i in spelt.items():
            for k in range(1, len(p)):
                a, b = spelt.get(p[:k]), spelt.get(p[k:])
                if a is not None and b is not None:
                    self.pairs[a, b] = i
        self._tabulate()

    def _tabulate(self) -> None:
        keys = np.array([a * self.size + b for a, b in self.pairs], dtype=np.uint64)
        merged = np.array(list(self.pairs.values()), dtype=np.int32)
        self.keys = np.full((1 << SLOTS) + 64, -1, dtype=np.int64)
        self.made = np.full((1 << SLOTS) + 64, -1, dtype=np.int32)
        at = (keys * np.uint64(C1) >> np.uint64(64 - SLOTS)).astype(np.int64)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):
            slot = at[left] + self.probes
            free = left[self.keys[slot] == -1]
            self.keys[at[free] + self.probes] = keys[free].astype(np.int64)
            took = self.keys[slot] == keys[left].astype(np.int64)
            self.made[slot[took]] = merged[left[took]]
            left, self.probes = left[~took], self.probes + 1

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        inside = (a >= 0) & (b >= 0) & (a < self.size) & (b < self.size)
        key = np.where(inside, a.astype(np.int64) * self.size + b, -2)
        at = (key.astype(np.uint64) * np.uint64(C1) >> np.uint64(64 - SLOTS)).astype(np.int64)
        out = np.full(a.shape, -1, dtype=np.int32)
        for p in range(self.probes):
            hit = self.keys[at + p] == key
            out[hit] = self.made[(at + p)[hit]]
        return out


def candidates(v: Vocabulary, a: np.ndarray, b: np.ndarray, start: np.ndarray, key: np.ndarray, threshold: int) -> np.ndarray:
    """Ranks of the merges of a[i] and b[i]; NEVER for none and for those that the keyed hash skips."""
    made = v.merge(a, b)
    out = np.where(made >= 0, v.rank[made], NEVER).astype(np.int32)
    if threshold:
        at = np.nonzero(made >= 0)
        k = key if key.ndim == made.ndim and key.shape == made.shape else np.broadcast_to(key, made.shape)
        h = mix(k[at] ^ (start[at].astype(np.uint64) * np.uint64(C1)) ^ (made[at].astype(np.uint64) * np.uint64(C3)))
        out[tuple(x[h < np.uint64(threshold)] for x in at)] = NEVER
    return out


def segment_heap(v: Vocabulary, chars: list[int], key: int, threshold: int) -> list[int]:
    """Agenda with a heap over one chunk's character ids."""
    n = len(chars)
    sym, left, right, gone = list(chars), list(range(-1, n - 1)), [*range(1, n), -1], [False] * n
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j >= 0 and (made := v.pairs.get((sym[i], sym[j]))) is not None:
            if threshold and mix_int(key ^ ((i * C1) & M64) ^ ((made * C3) & M64)) < threshold:
                return
            heapq.heappush(heap, (int(v.rank[made]), i, j, sym[i], sym[j]))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        rank, i, j, a, b = heapq.heappop(heap)
        if gone[i] or gone[j] or sym[i] != a or sym[j] != b or right[i] != j:
            continue
        sym[i], gone[j] = int(v.of_rank[rank]), True
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(left[i], i)
        offer(i, right[i])
    return [s for s, g in zip(sym, gone, strict=True) if not g]


def segment_many(v: Vocabulary, sym: np.ndarray, key: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Agendas of many chunks, one merge a round in each. sym: (n, width) character ids, -1 behind the end."""
    n, width = sym.shape
    out = np.full((n, width), -1, dtype=np.int32)
    rows = np.arange(n)
    start = np.broadcast_to(np.arange(width, dtype=np.int32), (n, width)).copy()
    if width > 1:
        rank = candidates(v, sym[:, :-1], sym[:, 1:], start[:, :-1], np.broadcast_to(key[:, None], (n, width - 1)), threshold)
    else:
        rank = np.full((n, 0), NEVER, dtype=np.int32)
    while len(rows) and rank.shape[1]:
        best = rank.argmin(axis=1)
        value = rank[np.arange(len(rows)), best]
        live = value < NEVER
        if not live.all():
            out[rows[~live], : sym.shape[1]] = sym[~live]
            rows, sym, start, rank, key, best, value = rows[live], sym[live], start[live], rank[live], key[live], best[live], value[live]
            if not len(rows):
                break
        m, width = sym.shape
        r = np.arange(m)
        col = np.arange(width - 1)[None]
        take = col + (col > best[:, None])
        sym = np.take_along_axis(sym, take, axis=1)
        start = np.take_along_axis(start, take, axis=1)
        sym[r, best] = v.of_rank[value]
        if width == 2:
            rank = np.full((m, 0), NEVER, dtype=np.int32)
            break
        col = np.arange(width - 2)[None]
        rank = np.take_along_axis(rank, col + (col >= best[:, None]), axis=1)
        for at in (best - 1, best):
            ok = np.flatnonzero((at >= 0) & (at < width - 2))
            p = at[ok]
            rank[ok, p] = candidates(v, sym[ok, p], sym[ok, p + 1], start[ok, p], key[ok], threshold)
    if len(rows):
        out[rows, : sym.shape[1]] = sym
    return out, (out >= 0).sum(axis=1)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the runs [start, start + length), one after another."""
    total = np.cumsum(lengths)
    return np.repeat(starts - (total - lengths), lengths) + np.arange(int(total[-1]) if len(total) else 0)


@lru_cache(maxsize=2)
def opened(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_batch(v: Vocabulary, texts: list[str], keys: list[int], dropout: float = DROPOUT, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all texts, and how many each has."""
    threshold = min(int(dropout * 2**64), M64)
    number: dict[str, int] = {}
    local: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if t:
            own = CHUNK.findall(" " + t)
            counts[i] = len(own)
            local += [number.setdefault(c, len(number)) for c in own]
    if not local:
        return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(local)) - (np.cumsum(counts) - counts)[doc]
    key = np.array([k & M64 for k in keys], dtype=np.uint64)[doc]
    draw = mix(mix(key + np.uint64(seed)) + place.astype(np.uint64) * np.uint64(C1))
    of = np.array(local, dtype=np.int64)
    if threshold:
        inverse = np.arange(len(of))
    else:  # equal chunks are equal throughout
        of, first, inverse = np.unique(of, return_index=True, return_inverse=True)
        draw = draw[first]
    chunks = list(number)
    points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    size = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
    begin = np.cumsum(size) - size
    power = np.full(int(size.max()), C1, dtype=np.uint64)
    power = np.multiply.accumulate(power)
    inner = np.arange(len(points)) - np.repeat(begin, size)
    digest = np.add.reduceat((points.astype(np.uint64) + np.uint64(1)) * power[inner], begin)
    char = v.char[points]
    hashed = mix(digest[of] + draw)
    lengths = size[of]
    got: list[np.ndarray | None] = []
    out_len = np.zeros(len(of), dtype=np.int64)
    out_at = np.zeros(len(of), dtype=np.int64)
    filled = 0
    low = 0
    for high in (6, 10, 16, 28, LONG):
        some = np.flatnonzero((lengths > low) & (lengths <= high))
        for cut in range(0, len(some), 20_000):
            rows = some[cut : cut + 20_000]
            col = np.arange(high)[None]
            inside = col < lengths[rows, None]
            sym = np.where(inside, char[np.minimum(begin[of[rows], None] + col, len(char) - 1)], -1).astype(np.int32)
            ids, n = segment_many(v, sym, hashed[rows], threshold)
            got.append(ids[ids >= 0])
            out_len[rows], out_at[rows] = n, filled + np.cumsum(n) - n
            filled += int(n.sum())
        low = high
    for i in np.flatnonzero(lengths > LONG):
        ids = segment_heap(v, char[begin[of[i]] : begin[of[i]] + lengths[i]].tolist(), int(hashed[i]), threshold)
        got.append(np.array(ids, dtype=np.int32))
        out_len[i], out_at[i] = len(ids), filled
        filled += len(ids)
    flat = np.concatenate(got)
    ids = flat[ragged(out_at[inverse], out_len[inverse])]
    pieces = np.bincount(doc, weights=out_len[inverse], minlength=len(texts)).astype(np.int64)
    odd = ids >= v.size
    if odd.any():  # spell characters outside the vocabulary in bytes
        text_of = np.repeat(np.arange(len(texts)), pieces)
        point = np.where(odd, ids - v.size, 0)
        width = np.where(odd, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000), 1)
        where = np.cumsum(width) - width
        spelt = np.empty(int(width.sum()), dtype=np.int32)
        spelt[where[~odd]] = ids[~odd]
        raw = np.frombuffer(b"".join(chr(p).encode("utf-8", "surrogatepass") for p in point[odd].tolist()), dtype=np.uint8)
        spelt[ragged(where[odd], width[odd])] = v.byte[raw]
        pieces = np.bincount(text_of, weights=width, minlength=len(texts)).astype(np.int64)
        ids = spelt
    return ids, pieces


def decode_batch(v: Vocabulary, ids: np.ndarray, pieces: np.ndarray) -> list[bytes]:
    """The UTF-8 bytes of each text, without the dummy prefix."""
    raw = v.byte_flat[ragged(v.byte_start[ids], v.byte_length[ids])].tobytes() if len(ids) else b""
    ends = np.concatenate([[0], np.cumsum(v.byte_length[ids])]) if len(ids) else np.zeros(1, dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(pieces)])
    return [raw[ends[a] + 1 : ends[b]] if b > a else b"" for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def encode(docs: DataFrame, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, carry: str = "doc_id long") -> DataFrame:
    """ids, n_pieces and whether the ids decode to the text, for every row."""
    names = [c.split()[0] for c in carry.split(", ")]
    docs.sparkSession.sparkContext.addFile(model)  # executors needn't have the file where the driver has it
    base = model.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = opened(SparkFiles.get(base))
        for batch in by_bytes(batches, "text", 2 << 20):
            at = batch.schema.get_field_index
            texts = [t or "" for t in batch.column(at("text")).to_pylist()]
            keys = [k or 0 for k in batch.column(at("doc_id")).to_pylist()]
            ids, pieces = encode_batch(v, texts, keys, dropout, seed)
            same = [a == t.encode("utf-8", "surrogatepass") for a, t in zip(decode_batch(v, ids, pieces), texts, strict=True)]
            offsets = pa.array(np.concatenate([[0], np.cumsum(pieces)]).astype(np.int32))
            own = [batch.column(at(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(pieces), pa.array(same)], names=[*names, "ids", "n_pieces", "lossless"])

    return docs.mapInArrow(run, f"{carry}, ids array<int>, n_pieces long, lossless boolean")


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return encode(docs)


QUERIES = {"op3_piece_codec": op3_piece_codec}
ORACLES: dict[str, str] = {}
