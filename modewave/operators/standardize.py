"""Anomalies, group scales, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import require


def feature_means(df: DataFrame, value: str = "x", *keys: str) -> DataFrame:
    """Mean over time of each feature: one partial aggregate, one shuffle of as many rows as there are features."""
    return df.groupBy(*(keys or ("feature_id",))).agg(F.avg(value).alias("mean"))


def anomalies(df: DataFrame, value: str = "x", *keys: str) -> DataFrame:
    """Adds ``mean`` and ``anomaly``. Features are far fewer than rows; adaptive execution broadcasts them if they are small."""
    keys = keys or ("feature_id",)
    return df.join(feature_means(df, value, *keys), list(keys)).withColumn("anomaly", F.col(value) - F.col("mean"))


def surface_scales(wide: DataFrame, area: str = "area") -> DataFrame:
    """One row: velocity_rms (u and v together) and eta_rms of anomalies au, av, aeta, weighted by area."""
    a = F.col(area)
    return wide.agg(
        F.sqrt(F.sum(a * (F.col("au") * F.col("au") + F.col("av") * F.col("av"))) / (2 * F.sum(a))).alias("velocity_rms"),
        F.sqrt(F.sum(a * F.col("aeta") * F.col("aeta")) / F.sum(a)).alias("eta_rms"),
    )


def group_scales(df: DataFrame, weight: str = "weight", group: str = "feature_group") -> DataFrame:
    """Of each group the RMS of anomalies under squared weights: sqrt(sum a^2 w^2 / sum w^2)."""
    w2 = F.col(weight) * F.col(weight)
    return df.groupBy(group).agg(F.sqrt(F.sum(F.col("anomaly") * F.col("anomaly") * w2) / F.sum(w2)).alias("rms"))


def scaled(df: DataFrame, scales: DataFrame, weight: str = "weight", group: str = "feature_group") -> DataFrame:
    """Adds ``scale`` = weight / RMS of the group, and ``x`` = anomaly * scale. Scales are a row per group."""
    bad = scales.where(F.col("rms").isNull() | F.isnan("rms") | (F.col("rms") <= 0)).count()
    require(bad == 0, "a group of features doesn't vary")
    return df.join(F.broadcast(scales), group).withColumn("scale", F.col(weight) / F.col("rms")).withColumn("x", F.col("anomaly") * F.col("scale"))


def total_sum_squares(df: DataFrame, value: str = "x") -> float:
    return float(df.agg(F.sum(F.col(value) * F.col(value))).first()[0] or 0.0)


def covariance(df: DataFrame, value: str = "x", time: str = "t", feature: str = "feature_id") -> DataFrame:
    """(i, j, cov) for i <= j by a self-join on time: for up to a few hundred features; beyond, use the block kernels."""
    n = df.select(time).distinct().count()
    a = df.select(time, F.col(feature).alias("i"), F.col(value).alias("xi"))
    b = df.select(time, F.col(feature).alias("j"), F.col(value).alias("xj"))
    return a.join(b, time).where("i <= j").groupBy("i", "j").agg((F.sum(F.col("xi") * F.col("xj")) / F.lit(n - 1)).alias("cov"))
