"""Statistics of modes and the tables behind figures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import NS_PER_DAY, day_index


def weighted_mean(x: Column, w: Column) -> Column:
    return F.sum(x * w) / F.sum(w)


def area_stats(cells: DataFrame, *keys: str) -> DataFrame:
    """Area-weighted means of u, v, eta over cells (area), the mean vector's size, area in km2 and cells, for each key."""
    a = F.col("area")
    out = cells.groupBy(*keys) if keys else cells.groupBy()
    out = out.agg(*(weighted_mean(F.col(c), a).alias(f"mean_{c}") for c in ("u", "v", "eta")), (F.sum(a) / 1e6).alias("area_km2"), F.count(F.lit(1)).alias("cells"))
    return out.withColumn("mean_speed", F.hypot("mean_u", "mean_v"))


def mode_stats(cells: DataFrame, *keys: str) -> DataFrame:
    """Of each mode: velocity RMS, 95th percentile of the speed, and how far the flow goes one way (0 to 1). Exact percentiles."""
    a, u, v = F.col("area"), F.col("u"), F.col("v")
    out = cells.groupBy(*(keys or ("mode",))).agg(
        weighted_mean(u, a).alias("mean_u"), weighted_mean(v, a).alias("mean_v"), weighted_mean(F.col("eta"), a).alias("mean_eta"),
        F.sqrt(weighted_mean(u * u + v * v, a)).alias("velocity_rms"), F.percentile(F.hypot("u", "v"), 0.95).alias("velocity_q95"),
    )
    one_way = F.when(F.col("velocity_rms") > 0, F.hypot("mean_u", "mean_v") / F.col("velocity_rms")).otherwise(0.0)
    return out.withColumn("directional_coherence", one_way)


def coverage(n_times: int, theoretical: int = 17_544) -> float:
    """Percent of the hours of two years."""
    return 100.0 * n_times / theoretical


def map_limits(cells: DataFrame, lon_span: float, *keys: str) -> DataFrame:
    """Of each map: the symmetric limit of eta, the reference arrow (95th percentile of non-zero speeds) and the quiver scale."""
    speed = F.hypot("u", "v")
    return cells.groupBy(*(keys or ("mode",))).agg(
        F.max(F.abs("eta")).alias("eta_limit"), F.percentile(F.when(speed > 0, speed), 0.95).alias("q95"), F.percentile(speed, 0.98).alias("p98")
    ).withColumn("quiver_scale", F.col("q95") / (0.045 * lon_span)).withColumn("speed_limit", F.greatest("p98", "q95", F.lit(2.220446049250313e-16)))


def daily_means(coefficients: DataFrame, value: str = "value") -> DataFrame:
    """(mode, day, t, mean, n) by UTC day; t is the day's start."""
    return coefficients.groupBy("mode", day_index("t").alias("day")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).withColumn("t", F.col("day") * F.lit(NS_PER_DAY))


def scree(spectrum: DataFrame) -> DataFrame:
    return spectrum.select("mode", (100 * F.col("ev")).alias("percent"), (100 * F.col("cum_ev")).alias("cumulative_percent"))


def quiver_step(n_rows: int, n_cols: int, most: int) -> int:
    return max(1, math.ceil(max(n_rows, n_cols) / most))


def figure_count(modes: int, per_mode: int = 8, shared: int = 8) -> int:
    """Logical figures of a water-column run: six level maps and two more per mode, one scree plot and seven coverage maps."""
    return modes * per_mode + shared
