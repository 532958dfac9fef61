"""Connected components of a link table by alternating star contractions.

Large stars move every larger neighbour to a node's least neighbour, small stars the smaller ones; both keep
components whole and end in stars around each component's least node after about log(n) turns. Each turn is
two grouped minima and two joins, and is written to the shared folder, so no list of neighbours is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltscan.llm.common import drop, materialise


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): each linked node and the least node of its component; roots are left out."""
    edges = materialise(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        last, edges = edges, materialise(small.distinct())
        drop(last, large)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
