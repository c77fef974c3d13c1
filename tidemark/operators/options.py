"""Option chains: the strike window around the spot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def strike_window(strikes: DataFrame, key: str, spot: float, each_side: int) -> DataFrame:
    """The strike nearest the spot (the lower on ties) and ``each_side`` on either side, shifted inward at the edges."""
    others = [c for c in strikes.columns if c not in (key, "strike")]
    w = Window.partitionBy(key).orderBy("strike", *others)
    rows = strikes.withColumn("i", F.row_number().over(w).cast("long")).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    near = rows.groupBy(key).agg(F.min_by("i", F.struct(F.abs(F.col("strike") - spot), "strike", "i")).alias("_a"), F.max("_n").alias("_m"))
    lo = F.greatest(F.lit(1), F.least(F.col("_a") - each_side, F.col("_m") - 2 * each_side))
    return rows.join(near, key).where(F.col("i").between(lo, lo + 2 * each_side)).drop("_n", "_a", "_m")
