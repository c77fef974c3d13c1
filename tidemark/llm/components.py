"""Connected components by alternating large-star and small-star steps.

Both steps are a minimum per node (combined before the shuffle) and one equi-join, so a hub with a third of
all edges costs a skewed join that adaptive execution splits, never a collected neighbour list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.workspace import Workspace


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, work: Workspace, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of any one orderable type -> ``(node, component)``, the smallest node it reaches.

    Only nodes with an edge to another node are returned; a caller treats the others as their own
    component.  Null ends and self-loops are ignored; no edges give an empty table.
    """
    edges = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    current = work.save(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0"
    )
    before = _checksum(current)
    for step in range(1, max_rounds + 1):
        if not before[0]:
            break
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        after_df = work.save(small, f"{name}-{step}")
        after = _checksum(after_df)
        work.drop(f"{name}-{step - 1}")
        current = after_df
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
