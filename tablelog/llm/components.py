"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelog.llm.common import checkpointed


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the
    edges are stars.  Each step is two shuffles of the edges; lineage is cut with
    ``checkpoint()``.  Self-edges and repeated edges are fine; an empty table
    gives an empty table.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = checkpointed(e)
    before = _digest(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours move to the least neighbour
        e = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = e.filter("u <> v").distinct()
        # small star: smaller neighbours, and the node itself, move to the least of them
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(least, "u")
        e = checkpointed(
            moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(moved.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        now = _digest(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _digest(e: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 32))).first())
