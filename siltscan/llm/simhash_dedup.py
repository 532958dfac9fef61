"""SimHash near-duplicates through pivot distance tables.

Fingerprints are made distinct first, so copies cost nothing. Links of up to `distance` (three) differing bits
are found exactly: the 64 bits are cut into distance + 2 blocks, of which two must be equal for such a pair, so each distinct
fingerprint is put in a table for every two blocks (ten). Inside a table's bucket a pivot table holds the
Hamming distances to reference fingerprints; pairs whose distances to any pivot differ by more than that
are discarded (triangle inequality), the survivors are verified bit by bit. A bucket passes on a spanning forest of its
links, never all pairs. A bucket beyond `BUCKET` fingerprints is dealt anew by three of distance + 3 blocks
of the bits that are still free, which finds the same links. Components come from star contractions.

Laws for odd input: very long texts are fingerprinted whole, shingle by shingle; equal fingerprints are one; a null, empty or blank text has fingerprint zero and links like any other; below `shingle`
words the whole sequence is one shingle; a null doc_id is never a component's id; repeated rows share their
component; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscan.llm.common import by_bytes, byte_column, materialise, table, words_of
from siltscan.llm.components import components

SEED = 42
DISTANCE = 3
PIVOTS = 16
#: Largest bucket that one task compares; larger ones are dealt anew by more blocks.
BUCKET = 20_000
#: Largest group compared by pivots after that; larger ones are looked up flip by flip.
FLIPS = 20_000


def fingerprint(words: list[bytes], shingle: int = 3) -> int:
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = [0, *ends[: len(words) - shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(text[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], dtype="<u8")
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        bits += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 8 << 20):
            fp = np.array([fingerprint(words_of(t), shingle) for t in byte_column(batch, "text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _masks(free: list[int], blocks: int, take: int) -> list[int]:
    """Masks of `take` out of `blocks` parts of the free bit positions."""
    parts = [sum(1 << int(x) for x in p) for p in np.array_split(np.array(free), blocks)]
    return [sum(c) for c in combinations(parts, take)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def masks(distance: int) -> tuple[list[int], list[list[int]]]:
    """Table keys for a distance: two of distance + 2 blocks of all bits; then, for each, three of distance + 3 blocks of the bits left free. Pairs within the distance agree on one of each."""
    first = _masks(list(range(64)), distance + 2, 2)
    return first, [_masks([i for i in range(64) if not m >> i & 1], distance + 3, 3) for m in first]


def pivot_table(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances of every fingerprint to every reference fingerprint."""
    return np.bitwise_count(fp[:, None] ^ pivots[None]).astype(np.int8)


def references(n: int = PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints, spread by a hash of their number."""
    return np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(n)], dtype=np.uint64)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of a[i] and b[i]; the least index is the root."""
    while len(a):
        parent = _roots(parent)
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
    return _roots(parent)


def bucket_forest(group: np.ndarray, fp: np.ndarray, pivots: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that span every component inside each group. group: sorted group numbers of the fingerprints."""
    d = pivot_table(fp, pivots)
    order = np.lexsort((fp, d[:, 0], group))
    group, fp, d = group[order], fp[order], d[order]
    parent = np.arange(len(fp))
    first = d[:, 0].astype(np.int16)
    at = np.arange(len(fp))
    k = 0
    while len(at):
        k += 1
        at = at[at + k < len(fp)]
        at = at[(group[at] == group[at + k]) & (first[at + k] - first[at] <= distance)]  # sorted: no later partner either
        left = at
        for p in range(1, pivots.shape[0]):
            if not len(left):
                break
            left = left[np.abs(d[left, p] - d[left + k, p]) <= distance]
        left = left[np.bitwise_count(fp[left] ^ fp[left + k]) <= distance]
        parent = _union(parent, left, left + k)
        if k % 32 == 0 and len(at):  # rows of a group that is one component already need no more partners
            start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            whole = np.maximum.reduceat(parent, start) == np.minimum.reduceat(parent, start)
            done = np.repeat(whole, np.diff(np.append(start, len(group))))
            at = at[~done[at]]
    moved = np.flatnonzero(parent != np.arange(len(fp)))
    return fp[moved], fp[parent[moved]]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of about `rows` rows made of whole groups; batches come sorted by the keys."""
    held: pa.Table | None = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if held.num_rows < rows:
            continue
        last = np.ones(held.num_rows, dtype=bool)
        for k in keys:
            x = held.column(k).to_numpy()
            last &= x == x[-1]
        cut = int(np.argmax(last))
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def _bounded(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int, most: int) -> Iterator[tuple[pa.Table, bool]]:
    """Whole groups as _groups() gives them, but one of more than `most` rows that doesn't end within `rows` comes in parts (True) and is never held."""
    held: pa.Table | None = None
    over: tuple | None = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if over is not None:
            same = np.ones(held.num_rows, dtype=bool)
            for k, x in zip(keys, over, strict=True):
                same &= held.column(k).to_numpy() == x
            n = int(same.sum())  # sorted: they lead
            if n:
                yield held.slice(0, n), True
            held = held.slice(n)
            if not held.num_rows:
                continue
            over = None
        if held.num_rows < rows:
            continue
        last = np.ones(held.num_rows, dtype=bool)
        for k in keys:
            x = held.column(k).to_numpy()
            last &= x == x[-1]
        cut = int(np.argmax(last))
        if cut:
            yield held.slice(0, cut), False
        held = held.slice(cut).combine_chunks()
        if held.num_rows > most:
            over = tuple(held.column(k)[0].as_py() for k in keys)
            yield held, True
            held = None
    if held is not None and held.num_rows:
        yield held, False


def flip_forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The links of bucket_forest() for one large group in which few bits vary: every flip of up to `distance` of them is looked up."""
    fp = np.sort(fp)
    vary = [1 << b for b in range(64) if int(np.bitwise_or.reduce(fp ^ fp[0])) >> b & 1]
    parent = np.arange(len(fp))
    for n in range(1, distance + 1):
        for c in combinations(vary, n):
            flipped = fp ^ np.uint64(sum(c))
            at = np.minimum(np.searchsorted(fp, flipped), len(fp) - 1)
            hit = np.flatnonzero(fp[at] == flipped)
            parent = _union(parent, hit, at[hit])
    moved = np.flatnonzero(parent != np.arange(len(fp)))
    return fp[moved], fp[parent[moved]]


def links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(fp) distinct -> (a, b): links that span all components of fingerprints within `distance` bits."""
    pivots = references()
    first, second = masks(distance)

    def keyed(fp: Column, masks: list[int]) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(i).cast("int").alias("t"), fp.bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)]))

    def compare(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
        names = ["t", "key"] if most else ["t", "t2", "key"]
        for tbl, part in _bounded(batches, names, 200_000, most or 1 << 62):
            if part:
                yield pa.RecordBatch.from_arrays([tbl.column(k).combine_chunks() for k in ("fp", "key", "t")], names=["a", "b", "t"])
                continue
            cols = [tbl.column(k).to_numpy() for k in names]
            fp = tbl.column("fp").to_numpy().view(np.uint64)
            new = np.concatenate([[False], np.any([c[1:] != c[:-1] for c in cols], axis=0)])
            group = np.cumsum(new)
            size = np.bincount(group)[group]
            some = (size > 1) & (size <= (most or FLIPS))
            a, b = bucket_forest(group[some], fp[some], pivots, distance) if some.any() else (fp[:0], fp[:0])
            if not most:  # the keys leave some 20 bits free, so a group has a million fingerprints at most
                more = [flip_forest(fp[group == g], distance) for g in np.unique(group[size > FLIPS])]
                a, b = (np.concatenate([x, *y]) for x, y in zip((a, b), zip(*more, strict=True) if more else ((), ()), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), -1, dtype=np.int32))], names=["a", "b", "t"])
            if most and (size > most).any():
                over = size > most
                x = fp[over].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(cols[1][over]), pa.array(cols[0][over].astype(np.int32))], names=["a", "b", "t"])

    put = fps.select("fp", keyed(F.col("fp"), first).alias("k")).select("fp", "k.t", "k.key").repartition("t", "key").sortWithinPartitions("t", "key")
    found = materialise(put.mapInArrow(lambda it: compare(it, bucket), "a long, b long, t int"))
    over = found.where("t >= 0")
    out = found.where("t < 0").select("a", "b")
    if not over.isEmpty():
        again = None
        for t, keys in enumerate(second):
            part = over.where(F.col("t") == t).select(F.col("t"), F.col("b").alias("first"), F.col("a").alias("fp"), keyed(F.col("a"), keys).alias("k"))
            part = part.select("t", F.col("k.t").alias("t2"), F.col("k.key").bitwiseOR(F.col("first")).alias("key"), "fp")
            again = part if again is None else again.unionByName(part)
        more = again.repartition("t", "t2", "key").sortWithinPartitions("t", "t2", "key").mapInArrow(lambda it: compare(it, None), "a long, b long, t int")
        out = out.unionByName(more.select("a", "b"))
    return out


def cluster(docs: DataFrame, shingle: int = 3, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id."""
    prints = materialise(fingerprints(docs, shingle))
    fps = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(fps.select("fp"), distance))
    named = materialise(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # joins are between written tables, so that the engine splits a very large component or group of copies
    ids = materialise(named.groupBy("root").agg(F.min("least").alias("component_id")))
    of = materialise(named.join(ids, "root").select("fp", "component_id"))
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op4_simhash_dedup": op4_simhash_dedup}
ORACLES: dict[str, str] = {}
