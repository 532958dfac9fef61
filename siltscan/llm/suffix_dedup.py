"""Removal of repeated 200-byte strings by deep-shallow suffix sorting.

Sorting every suffix of a corpus would ship each byte hundreds of times. Instead each 200-byte window names one
anchor, the leftmost least hash among its 32-byte strings, so equal windows name equal anchors at equal places, and only the suffixes
(and, backwards, the prefixes) at anchors whose hash recurs are sorted:

1. scan: (anchor hash, text key, times) rows, one for each text and hash; hashes that occur once are dropped;
2. equal texts are one text (its key is half of its SHA-256), and texts with a copy are removed whole;
3. the contexts (the windows of an anchor) of the rest are made distinct before they are dealt by hash;
4. each task orders the contexts to the right of the anchors, and the reversed ones to the left: multikey quicksort over 8-byte
   characters to a shallow depth, then a blind trie for each group that still shares a prefix; adjacent common prefixes
   give, for each shift of the window, the classes of equal left and right parts, hence the windows that recur;
5. covered spans go back to the texts.

Joins by hash or key are between written tables, so that the engine splits those of a very frequent hash. A text longer than `PIECE` is
scanned in overlapping pieces; every window lies in just one. Among the strings of a window the anchor is the leftmost one with the least upper 40 bits,
whatever batch it comes in.

A hash with more than `GROUP` distinct contexts isn't collected: its windows are counted one by one, by digest and shift, which is exact as well.

Laws for odd input: a null doc_id is carried through; a null text is empty; texts under 200 bytes keep all; repeated rows are copies of each other; matches never cross
texts; spans are judged on the input; an empty table gives an empty result; extra columns are ignored. `cut_texts` trims
spans to whole characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscan.llm.common import Scratch, by_bytes, byte_column, drop, materialise, table

SPAN = 200
GRAM = 32
INSIDE = SPAN - GRAM + 1
SHALLOW = 5  # 8-byte characters
GROUP = 32_768
#: Bytes of a text that are scanned at a time; with a batch of other texts they stay under 2 ** PLACE_BITS.
PIECE = 4 << 20
PLACE_BITS = 24


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every 32-byte string, by doubling."""
    h = text.astype(np.uint64) + np.uint64(1)
    m, step = 0x9E3779B97F4A7C15, 1
    while step < GRAM:
        h = h[:-step] * np.uint64(m) + h[step:]
        m = (m * m) & ((1 << 64) - 1)
        h ^= h >> np.uint64(29)
        step *= 2
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    n = len(key) - width + 1
    blocks = -(-len(key) // width)
    pad = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    pad[: len(key)] = key
    grid = pad.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of several texts: text number, place in the joined texts, least and largest shift of its windows, hash; and where texts begin."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(size) - size
    none = np.zeros(0, dtype=np.int64)
    if not (size >= SPAN).any():
        return none, none, none, none, none.astype(np.uint64), begin
    joined = np.frombuffer(b"".join(texts), dtype=np.uint8)
    h = gram_hashes(joined)
    if len(joined) >> PLACE_BITS:
        raise ValueError("pieces are too long")
    bits = np.uint64(PLACE_BITS)
    least = sliding_least((h >> bits << bits) | np.arange(len(h), dtype=np.uint64), INSIDE)
    valid = np.ones(len(joined), dtype=bool)
    for b, n in zip(begin.tolist(), size.tolist(), strict=True):
        valid[max(b, b + n - SPAN + 1) : b + n] = False
    at = np.flatnonzero(valid[: len(least)])
    place = (least[at] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]))
    last = np.append(first[1:], len(at)) - 1
    place_of = place[first]
    doc = np.searchsorted(begin, at[first], side="right") - 1
    return doc, place_of, place_of - at[last], place_of - at[first], h[place_of], begin


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Order of strings of one length, by a trie that keeps only branching places and characters."""
    width = len(strings[0])
    numbers = [int.from_bytes(s, "big") for s in strings]
    # a node is [depth, {byte: child}] with an int leaf (first of equal strings) below
    equal: dict[int, list[int]] = {0: [0]}
    root: list | int = 0
    for i in range(1, len(strings)):
        s = strings[i]
        node = root
        while not isinstance(node, int):  # blind descent: compare branching characters only
            node = node[1].get(s[node[0]]) if s[node[0]] in node[1] else next(iter(node[1].values()))
        differ = numbers[i] ^ numbers[node]
        if not differ:
            equal[node].append(i)
            continue
        equal[i] = [i]
        depth = width - (differ.bit_length() + 7) // 8
        up, key, below = None, None, root
        while not isinstance(below, int) and below[0] < depth:
            up, key, below = below, s[below[0]], below[1][s[below[0]]]
        if not isinstance(below, int) and below[0] == depth:
            below[1][s[depth]] = i
            continue
        made = [depth, {strings[node][depth]: below, s[depth]: i}]
        if up is None:
            root = made
        else:
            up[1][key] = made
    out: list[int] = []
    stack: list = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, int):
            out += equal[node]
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def deep_shallow(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order rows (n, width) of bytes within groups; common prefix with the row before (-1 where a group begins)."""
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    words[:, :width] = rows
    words = words.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    # parts are numbered by their first place, so that splitting one never meets another's number
    new = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    part = np.flatnonzero(new)[np.cumsum(new) - 1]
    for depth in range(min(SHALLOW, words.shape[1])):
        open_ = np.flatnonzero(np.bincount(part, minlength=n)[part] > 1)
        if not len(open_):
            break
        own = part[open_]
        put = np.lexsort((words[order[open_], depth], own))
        order[open_] = order[open_][put]
        w = words[order[open_], depth]
        split = np.concatenate([[True], (own[1:] != own[:-1]) | (w[1:] != w[:-1])])
        part[open_] = open_[np.flatnonzero(split)][np.cumsum(split) - 1]
    first, size = np.unique(part, return_counts=True)
    for a, m in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        own = order[a : a + m]
        own = own[np.argsort(own)]
        order[a : a + m] = own[blind_trie_order([rows[i].tobytes() for i in own])]
    prefix = np.full(n, -1, dtype=np.int64)
    if n > 1:
        for at in range(1, n, 16_384):
            hi = min(n, at + 16_384)
            differ = rows[order[at:hi]] != rows[order[at - 1 : hi - 1]]
            same = ~differ.any(axis=1)
            prefix[at:hi] = np.where(same, width, differ.argmax(axis=1))
        g = group[order]
        prefix[1:][g[1:] != g[:-1]] = -1
    return order, prefix


def recurring_shifts(group: np.ndarray, contexts: list[bytes], low: np.ndarray, high: np.ndarray, times: np.ndarray) -> np.ndarray:
    """(rows, INSIDE) booleans: the window that begins `shift` bytes before the anchor recurs."""
    n = len(contexts)
    right = np.zeros((n, SPAN), dtype=np.uint8)
    left = np.zeros((n, INSIDE), dtype=np.uint8)
    for i, (c, h) in enumerate(zip(contexts, high.tolist(), strict=True)):
        x = np.frombuffer(c, dtype=np.uint8)
        right[i, : len(c) - h] = x[h:]
        left[i, :h] = x[:h][::-1]
    shift = np.arange(INSIDE)
    inside = (low[:, None] <= shift) & (shift <= high[:, None])
    cover = inside & (times >= 2)[:, None]
    order_r, prefix_r = deep_shallow(group, right)
    order_l, prefix_l = deep_shallow(group, left)
    class_r, class_l = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for s in range(INSIDE):
        some = np.flatnonzero(inside[:, s])
        if len(some) < 2:
            continue
        class_r[order_r] = np.cumsum(prefix_r < SPAN - s)
        class_l[order_l] = np.cumsum(prefix_l < s)
        key = class_r[some] * np.int64(n + 1) + class_l[some]
        put = np.argsort(key, kind="stable")
        k = key[put]
        same = k[1:] == k[:-1]
        cover[some[put[1:][same]], s] = True
        cover[some[put[:-1][same]], s] = True
    return cover


def runs(cover: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last shift of each run of true values."""
    pad = np.zeros((cover.shape[0], cover.shape[1] + 2), dtype=np.int8)
    pad[:, 1:-1] = cover
    step = np.diff(pad, axis=1)
    row, first = np.nonzero(step == 1)
    _, last = np.nonzero(step == -1)
    return row, first, last - 1


def pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Numbers of texts, where in them each piece begins, and the pieces: all texts together, but long ones piece by piece. No window lies in two."""
    short = [i for i, t in enumerate(texts) if len(t) <= PIECE]
    yield short, [0] * len(short), [texts[i] for i in short]
    for i, t in enumerate(texts):
        if len(t) > PIECE:
            for at in range(0, len(t) - SPAN + 1, PIECE - SPAN + 1):
                yield [i], [at], [t[at : at + PIECE]]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text", 2 << 20):
        docs, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
        for of, _, parts in pieces(byte_column(batch, "text")):
            doc, _, _, _, h, _ = anchors(parts)
            docs.append(np.array(of, dtype=np.int64)[doc])
            hashes.append(h)
        doc, h = np.concatenate(docs), np.concatenate(hashes)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])) if len(doc) else doc
        times = np.diff(np.append(first, len(doc)))
        yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), batch.column(0).take(pa.array(doc[first])), pa.array(times.astype(np.int32))], names=["h", "key", "times"])


CONTEXT = "key binary, h long, high int, low int, context binary, places array<long>"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, hashes) -> the distinct contexts of each text at these hashes, with their places."""
    for batch in by_bytes(batches, "text", 1 << 20):
        keys, wanted = batch.column(0).to_pylist(), [set(w) for w in batch.column(2).to_pylist()]
        texts = byte_column(batch, "text")
        found: dict[tuple, list[int]] = {}
        for of, starts, parts in pieces(texts):
            doc, place, low, high, h, begin = anchors(parts)
            for d, p, lo, hi, x in zip(doc.tolist(), (place - begin[doc]).tolist(), low.tolist(), high.tolist(), h.view(np.int64).tolist(), strict=True):
                if x in wanted[of[d]]:
                    found.setdefault((of[d], x, hi, lo, parts[d][p - hi : p - lo + SPAN]), []).append(p + starts[d])
        rows = [(keys[d], x, hi, lo, c, at) for (d, x, hi, lo, c), at in found.items()]
        kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=[c.split()[0] for c in CONTEXT.split(", ")])


FOUND = "h long, high int, digest long, first array<int>, last array<int>"


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by hash -> the recurring runs of shifts of each context, whole groups at a time."""
    held: list[pa.RecordBatch] = []
    count = 0

    def done(tbl: pa.Table) -> pa.RecordBatch:
        h = tbl.column("h").to_numpy()
        group = np.cumsum(np.concatenate([[0], (h[1:] != h[:-1]).astype(np.int64)]))
        row, first, last = runs(recurring_shifts(group, tbl.column("context").to_pylist(), tbl.column("low").to_numpy().astype(np.int64), tbl.column("high").to_numpy().astype(np.int64), tbl.column("times").to_numpy()))
        rows, starts = np.unique(row, return_index=True)
        ends = np.append(starts, len(row)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (first, last)]
        picked = tbl.take(pa.array(rows)).combine_chunks()
        cols = [picked.column(c).combine_chunks() for c in ("h", "high", "digest")]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) for c in cols] + lists, names=[c.split()[0] for c in FOUND.split(", ")])

    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            held.append(part)
            count += part.num_rows
            if count < 16_384:
                continue
            tbl = pa.Table.from_batches(held)
            h = tbl.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield done(tbl.slice(0, cut).combine_chunks())
                held = tbl.slice(cut).combine_chunks().to_batches()
                count = tbl.num_rows - cut
    if count:
        yield done(pa.Table.from_batches(held).combine_chunks())


def _single_windows(contexts: DataFrame) -> DataFrame:
    """The same as _sort_groups for hashes with very many contexts: windows are counted by digest and shift."""
    one = contexts.select("h", "high", "digest", "low", "times", "context", F.explode(F.sequence("low", "high")).alias("shift"))
    one = one.withColumn("window", F.sha2(F.expr(f"substring(context, high - shift + 1, {SPAN})"), 256)).drop("context", "low")
    seen = one.groupBy("h", "shift", "window").agg(F.sum("times").alias("n")).where("n >= 2").drop("n")
    return one.join(seen, ["h", "shift", "window"]).select("h", "high", "digest", F.array("shift").alias("first"), F.array("shift").alias("last"))


def key_of(sha: Column | str) -> Column:
    """Sixteen bytes of a text's hexadecimal SHA-256."""
    return F.unhex(F.substring(sha, 1, 32))


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) -> rows (doc_id, key, n_bytes, whole, sha) and, for texts in part removed, (key, text, marks)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("sha", F.sha2("text", 256)).withColumn("key", key_of("sha"))
    named = materialise(docs.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), "sha"))
    copies = materialise(named.where(f"n_bytes >= {SPAN}").groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("key", F.lit(True).alias("whole")))
    rows = materialise(named.join(copies, "key", "left").withColumn("whole", F.coalesce("whole", F.lit(False))))
    drop(named, copies)

    seen = materialise(docs.select("key", "text").where(f"octet_length(text) >= {SPAN}").mapInArrow(_scan, "h long, key binary, times int"))
    twice = materialise(seen.groupBy("h").agg(F.sum("times").alias("n")).where("n > 1").select("h"))
    some = materialise(seen.join(twice, "h").groupBy("h", "key").agg(F.max("times").alias("times")))  # copies say the same
    drop(seen, twice)
    twice = materialise(some.groupBy("h").agg(F.sum("times").alias("n")).where("n > 1").select("h"))
    wanted = some.join(twice, "h").groupBy("key").agg(F.collect_set("h").alias("hashes"))
    # tasks make their copies one before texts are dealt, which happens once: the join is by the same key
    texts = docs.select("key", "text").where(f"octet_length(text) >= {SPAN}").dropDuplicates(["key"])
    touched = materialise(texts.join(wanted, "key"))
    drop(some, twice)

    placed = materialise(touched.select("key", "text", "hashes").mapInArrow(_contexts, CONTEXT).withColumn("digest", F.xxhash64("context", "low")))
    distinct = placed.groupBy("h", "high", "low", "digest", "context").agg(F.sum(F.size("places")).cast("long").alias("times"))
    large = placed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("h")
    large = materialise(large)
    if large.isEmpty():
        small, rest = distinct, None
    else:
        small, rest = distinct.join(large, "h", "left_anti"), distinct.join(large, "h", "left_semi")
    found = small.select("h", "high", "low", "digest", "context", "times").repartition("h").sortWithinPartitions("h", "high", "digest").mapInArrow(_sort_groups, FOUND)
    if rest is not None:
        found = found.unionByName(_single_windows(rest))
    found = materialise(found)
    marks = placed.select("key", "h", "high", "digest", "places").join(found, ["h", "high", "digest"])
    marks = marks.select("key", F.explode("places").alias("place"), "first", "last").select("key", "place", F.explode(F.arrays_zip("first", "last")).alias("r"))
    marks = marks.select("key", (F.col("place") - F.col("r.last")).alias("start"), (F.col("place") - F.col("r.first") + SPAN).alias("end"))
    marks = marks.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("marks"))
    return rows, touched.select("key", "text").join(marks, "key")


def merged(marks: list[dict]) -> list[tuple[int, int]]:
    """Maximal removed runs."""
    out: list[list[int]] = []
    for a, b in sorted((m["start"], m["end"]) for m in marks):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in gone:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def removed(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 4 << 20):
            out = []
            for text, marks in zip(byte_column(batch, "text"), batch.column(2).to_pylist(), strict=True):
                gone = merged(marks)
                out.append((sum(b - a for a, b in gone), len(gone), hashlib.sha256(_cut(text, gone)).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, kinds, strict=True))], names=["key", "r", "s", "k"])

    with Scratch() as inner:
        rows, partly = spans(docs)
        found = materialise(partly.select("key", "text", "marks").mapInArrow(run, "key binary, r long, s long, k string"))
        inner.keep(rows, found)
    out = rows.join(found, "key", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id", "n_bytes",
        F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.coalesce("r", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("whole"), F.lit(1)).otherwise(F.coalesce("s", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("whole"), F.lit(nothing)).otherwise(F.coalesce("k", "sha")).alias("kept_sha256"),
    )


def cut_texts(docs: DataFrame) -> DataFrame:
    """The same rows and columns, with repeated strings cut from `text`; spans shrink to whole characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 4 << 20):
            out = []
            for text, marks in zip(byte_column(batch, "text"), batch.column(2).to_pylist(), strict=True):
                gone = []
                for a, b in merged(marks):
                    while a < b and text[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
                        b -= 1
                    gone.append((a, b))
                out.append(_cut(text, gone).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["key", "cut"])

    with Scratch() as inner:
        rows, partly = spans(docs)
        cut = partly.select("key", "text", "marks").mapInArrow(run, "key binary, cut string")
        whole = rows.where("whole").select("key", F.lit("").alias("cut")).distinct()
        new = materialise(cut.join(whole.select("key"), "key", "left_anti").unionByName(whole))
        inner.keep(new)
    own = docs.columns
    text = own.index("text")
    out = docs.toDF(*[f"c{i}" for i in range(len(own))])  # no name of the caller's meets one of ours
    out = out.withColumn("key", key_of(F.sha2(F.coalesce(F.col(f"c{text}").cast("string"), F.lit("")), 256))).join(new, "key", "left")
    return out.select(*[(F.coalesce("cut", f"c{i}") if i == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(own)])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
ORACLES: dict[str, str] = {}
