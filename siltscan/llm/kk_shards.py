"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Documents with equal texts form a group that must stay together. Group sizes are summed before any
differencing, so a text with very many copies costs one row. Differencing runs as a tree: each task
differences a bounded chunk of groups into one partial partition (a vector of `shards` sums); the
partial partitions are themselves combined, chunk by chunk, until one is left. Every level only keeps
(part, place) -> (part above, place above) rows, so neither the driver nor a task ever holds all groups.

The join of rows with their group's shard is of two written tables, so that a group with very many rows is split by the engine.

Laws for odd input: a null doc_id is a row like any other; repeated rows get slots of their own; very long texts are only measured and digested; a null text counts as the empty text (size 8, crc32 0); equal texts share a shard
however large their group; an empty table gives an empty result; ties in size are broken by group key,
so the result does not depend on the order of rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltscan.llm.common import materialise, table

SHARDS = 24
#: Groups (or partial partitions) that one task differences at a time.
CHUNK = 16384


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over k-way partial partitions.

    parts: (n, k) sums, each row in any order. Returns the k sums of the result, largest first, and
    places (n, k): the place in the result that takes place j of part i.
    """
    n, k = parts.shape
    order = np.argsort(-parts, axis=1, kind="stable")
    sums = {i: np.take(parts[i], order[i]) for i in range(n)}
    # perm[i][j]: where sorted place j of node i goes in its parent; resolved from the root downwards
    parent: dict[int, tuple[int, np.ndarray]] = {}
    heap = [(-int(s[0] - s[-1]), i) for i, s in sums.items()]
    heapq.heapify(heap)
    fresh = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        joined = sums.pop(a) + sums.pop(b)[::-1]
        rank = np.argsort(-joined, kind="stable")
        to = np.empty(k, dtype=np.int16)
        to[rank] = np.arange(k)
        parent[a], parent[b] = (fresh, to), (fresh, to[::-1])
        sums[fresh] = joined[rank]
        heapq.heappush(heap, (-int(sums[fresh][0] - sums[fresh][-1]), fresh))
        fresh += 1
    root = heap[0][1]
    at: dict[int, np.ndarray] = {root: np.arange(k, dtype=np.int16)}
    for node in range(fresh - 1, -1, -1):
        if node != root:
            up, to = parent[node]
            at[node] = at[up][to]
    places = np.empty((n, k), dtype=np.int16)
    for i in range(n):
        places[i, order[i]] = at[i]
    return sums[root], places


def _difference_chunks(shards: int):
    """(chunk, id, sums) rows, a chunk's rows together -> placings, and the chunk's own partial partition."""

    def run(key: tuple, tbl: pa.Table) -> pa.Table:
        ids = tbl.column("id").to_numpy()
        width = pc.list_value_length(tbl.column("sums")).to_numpy()
        flat = tbl.column("sums").combine_chunks().flatten().to_numpy()
        parts = np.zeros((len(ids), shards), dtype=np.int64)
        parts[np.repeat(np.arange(len(ids)), width), np.concatenate([np.arange(w) for w in width])] = flat
        order = np.argsort(ids, kind="stable")  # rows come in any order; results must not depend on it
        total, places = difference(parts[order])
        rows = [places[i, :w].tolist() for i, w in enumerate(width[order])]
        chunk = key[0].as_py()
        return pa.table({
            "chunk": pa.array([chunk] * (len(ids) + 1), pa.int64()),
            "id": pa.array([*ids[order].tolist(), None], pa.int64()),
            "places": pa.array([*rows, None], pa.list_(pa.int16())),
            "sums": pa.array([*[None] * len(ids), total.tolist()], pa.list_(pa.int64())),
        })

    return run


def kk_assign(groups: DataFrame, shards: int, chunk: int = CHUNK) -> DataFrame:
    """(id long, size long) -> (id, shard int), by a tree of differencing steps over bounded chunks."""
    level = groups.select(F.col("id"), F.array(F.col("size")).alias("sums"))
    n = groups.count()
    placing: DataFrame | None = None
    first = True
    while True:
        chunks = max(1, math.ceil(n / chunk))
        # hashed ids spread over the chunks evenly; the ids of later levels are chunk numbers
        put = level.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)))
        out = materialise(put.groupBy("chunk").applyInArrow(_difference_chunks(shards), "chunk long, id long, places array<smallint>, sums array<long>"))
        step = out.where("sums is null").select("id", "chunk", "places")
        if first:
            placing = step.select("id", "chunk", F.col("places")[0].alias("place"))
        else:
            placing = placing.join(step.withColumnRenamed("id", "below").withColumnRenamed("chunk", "above"), F.col("chunk") == F.col("below")).select("id", F.col("above").alias("chunk"), F.expr("places[place]").alias("place"))
        if chunks == 1:
            return placing.select("id", F.col("place").cast("int").alias("shard"))
        first = False
        level = out.where("sums is not null").select(F.col("chunk").alias("id"), "sums")
        n = level.count()


def shard_documents(docs: DataFrame, shards: int = SHARDS, rows_per_bucket: int = 50_000) -> DataFrame:
    """Shard and gapless slot of every document; equal texts share a shard."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = materialise(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.sha2(text, 256).substr(1, 32).alias("group"),
    ))
    # ids of groups come from the group's own digest: no global numbering is needed
    key = F.xxhash64("group").alias("id")
    sizes = rows.groupBy("group").agg(F.sum("size").alias("size")).select(key, "size").groupBy("id").agg(F.sum("size").alias("size"))
    placed = materialise(kk_assign(sizes, shards))
    out = rows.select("doc_id", "size", "text_crc32", key).join(placed, "id").drop("id")
    # slots: number within (shard, bucket), then add the rows of the shard's earlier buckets
    n = rows.count()
    buckets = max(8, math.ceil(n / rows_per_bucket))
    out = materialise(out.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).cast("int")))
    counts = out.groupBy("shard", "bucket").count()
    starts = counts.withColumn("start", F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    starts = starts.select("shard", "bucket", F.coalesce("start", F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32"))
    numbered = out.withColumn("n", within).join(starts, ["shard", "bucket"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_kk_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_kk_shards": op10_kk_shards}
ORACLES: dict[str, str] = {}
