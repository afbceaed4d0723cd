"""From a decomposition to tables: signs, physical loadings, standardised coefficients."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import require
from .solvers import Svd

TINY = 1e-14


def signs(u: np.ndarray, anchors: list[tuple[str, int]]) -> tuple[np.ndarray, list[str]]:
    """+1 or -1 for each mode, and which loading decided: the first of ``anchors`` (name, feature) that is not negligible, else the largest."""
    out, why = [], []
    for column in u.T:
        name, at = next(((n, i) for n, i in anchors if abs(column[i]) > TINY), ("largest_absolute_loading", int(np.abs(column).argmax())))
        out.append(-1.0 if column[at] < 0 else 1.0)
        why.append(name)
    return np.array(out), why


def standardised(pc: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients without mean over their sample deviation, the deviations, and the largest mean that was taken off."""
    require(pc.shape[1] >= 2, "a sample deviation needs two times")
    mean = pc.mean(axis=1, keepdims=True)
    std = (pc - mean).std(axis=1, ddof=1)
    require(bool(np.isfinite(std).all() and (std > 0).all()), "a coefficient doesn't vary")
    return (pc - mean) / std[:, None], std, float(np.abs(mean).max())


def spectrum_table(spark: SparkSession, svd: Svd) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame({"mode": np.arange(1, len(svd.s) + 1), "sigma": svd.s, "ev": svd.explained, "cum_ev": svd.cumulative}), "mode int, sigma double, ev double, cum_ev double")


def loadings_table(spark: SparkSession, u: np.ndarray, name: str = "loading") -> DataFrame:
    """(mode, feature_id, loading)."""
    f, k = u.shape
    return spark.createDataFrame(pd.DataFrame({"mode": np.repeat(np.arange(1, k + 1), f), "feature_id": np.tile(np.arange(f), k), name: u.T.ravel()}), f"mode int, feature_id long, {name} double")


def coefficients_table(spark: SparkSession, pc: np.ndarray, axis: np.ndarray) -> DataFrame:
    """(mode, t, value, standardised)."""
    k, n = pc.shape
    std, _, _ = standardised(pc)
    return spark.createDataFrame(pd.DataFrame({"mode": np.repeat(np.arange(1, k + 1), n), "t": np.tile(axis, k), "value": pc.ravel(), "standardised": std.ravel()}), "mode int, t long, value double, standardised double")


def physical(loadings: DataFrame, features: DataFrame) -> DataFrame:
    """Loadings over the scale of their feature, in physical units per unit of the coefficient."""
    return loadings.join(features.select("feature_id", "scale"), "feature_id").withColumn("physical", F.col("loading") / F.col("scale")).drop("scale")


def regression(physical_modes: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Physical loadings per standard deviation of their coefficient."""
    std = coefficients.groupBy("mode").agg(F.stddev_samp("value").alias("std"))
    return physical_modes.join(F.broadcast(std), "mode").withColumn("regression", F.col("physical") * F.col("std")).drop("std")


def orthogonality(loadings: DataFrame, value: str = "loading") -> DataFrame:
    """One row: the largest departure of the loadings' Gram matrix from the identity, by a self-join on the feature."""
    a = loadings.select("feature_id", F.col("mode").alias("i"), F.col(value).alias("a"))
    b = loadings.select("feature_id", F.col("mode").alias("j"), F.col(value).alias("b"))
    dots = a.join(b, "feature_id").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("d"))
    return dots.agg(F.max(F.abs(F.col("d") - (F.col("i") == F.col("j")).cast("double"))).alias("departure"))


def reconstruct(features: DataFrame, physical_modes: DataFrame, coefficients: DataFrame, rank: int, times: DataFrame | None = None) -> DataFrame:
    """(feature_id, t, value): mean plus the sum over modes of loading times coefficient, for the given times (t) or all."""
    pc = coefficients.where(F.col("mode") <= rank)
    pc = pc.join(F.broadcast(times), "t", "left_semi") if times is not None else pc
    parts = physical_modes.where(F.col("mode") <= rank).join(pc, "mode").groupBy("feature_id", "t").agg(F.sum(F.col("physical") * F.col("value")).alias("a"))
    return parts.join(features.select("feature_id", "mean"), "feature_id").select("feature_id", "t", (F.col("mean") + F.col("a")).alias("value"))


def host_layout(loadings: DataFrame, coefficients: DataFrame, spectrum: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(left vectors, right vectors): features keep their order eta, u, v; the right ones are coefficients over sigma. Nothing is solved again."""
    right = coefficients.join(F.broadcast(spectrum.select("mode", "sigma")), "mode").select("mode", "t", (F.col("value") / F.col("sigma")).alias("value"))
    return loadings.select("mode", "feature_id", "loading"), right


def round_trip(physical_modes: DataFrame, left: DataFrame, features: DataFrame) -> DataFrame:
    """One row: the largest difference between physical modes and those rebuilt from the left vectors."""
    rebuilt = left.join(features.select("feature_id", "scale"), "feature_id").select("mode", "feature_id", (F.col("loading") / F.col("scale")).alias("again"))
    return physical_modes.join(rebuilt, ["mode", "feature_id"], "full").agg(F.max(F.abs(F.coalesce("physical", F.lit(float("inf"))) - F.coalesce("again", F.lit(0.0)))).alias("difference"))
