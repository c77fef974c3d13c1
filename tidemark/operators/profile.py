"""Volume profiles: bins, point of control and value area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile_bins(bars: DataFrame, keys: list[str], bin_size: int) -> DataFrame:
    """Each bar's volume spread evenly over the bins from the floor of its low to the ceiling of its high, both included; the last bin takes the rounding rest."""
    lo = F.floor(F.col("low") / bin_size).cast("long")
    hi = F.ceil(F.col("high") / bin_size).cast("long")
    n = (hi - lo + 1).cast("int")
    share = F.round(F.col("volume").cast("double") / n, 6).cast("decimal(18,6)")
    rows = bars.select(*keys, n.alias("_n"), share.alias("_s"), F.col("volume").alias("_v"), F.posexplode(F.sequence(lo, hi)).alias("_i", "bin"))
    part = F.when(F.col("_i") == F.col("_n") - 1, F.col("_v") - F.col("_s") * (F.col("_n") - 1)).otherwise(F.col("_s"))
    return rows.groupBy(*keys, (F.col("bin") * bin_size).cast("long").alias("price")).agg(F.sum(part).cast("double").alias("volume"))


def value_area(bins: DataFrame, keys: list[str], share: float = 0.7) -> DataFrame:
    """Point of control (largest volume, higher price on ties) and the area grown from it over populated bins, the heavier
    neighbour first and the lower one on ties, until it holds ``share`` of the volume.  The growth is a fold over the bins of one profile."""
    packed = bins.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("price", "volume"))).alias("b"), F.sum(F.col("volume").cast("decimal(18,6)")).cast("double").alias("total"), F.max_by("price", F.struct("volume", "price")).alias("poc"))
    at = F.expr("array_position(transform(b, x -> x.price), poc)").cast("int")
    packed = packed.withColumn("p", at)
    grown = F.expr(f"""aggregate(sequence(1, size(b)), struct(p as l, p as r, element_at(b, p).volume as inc),
      (s, i) -> CASE WHEN s.inc >= {share} * total THEN s
        WHEN s.l > 1 AND (s.r >= size(b) OR element_at(b, s.l - 1).volume >= element_at(b, s.r + 1).volume)
          THEN struct(s.l - 1 as l, s.r as r, s.inc + element_at(b, s.l - 1).volume as inc)
        WHEN s.r < size(b) THEN struct(s.l as l, s.r + 1 as r, s.inc + element_at(b, s.r + 1).volume as inc) ELSE s END)""")
    return packed.withColumn("g", grown).select(*keys, "poc", F.expr("element_at(b, g.l).price").alias("value_area_low"), F.expr("element_at(b, g.r).price").alias("value_area_high"), F.col("total").alias("total_volume"), F.size("b").cast("long").alias("n_bins"))


def profile_location(closes: DataFrame, bin_size: int) -> DataFrame:
    """Region of a close against its profile and its score: outside the value area, within half a bin of the point of control, or either part between."""
    c = F.col("close").cast("double")
    region = (
        F.when(c < F.col("value_area_low"), "below_value").when(c > F.col("value_area_high"), "above_value").when(F.abs(c - F.col("poc")) <= bin_size / 2, "at_poc")
        .when(c < F.col("poc"), "lower_value").otherwise("upper_value"))
    score = F.when(region == "above_value", 2).when(region == "upper_value", 1).when(region == "at_poc", 0).when(region == "lower_value", -1).otherwise(-2)
    return closes.withColumn("region", region).withColumn("score", score)
