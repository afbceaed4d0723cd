"""The demonstration cube: months by nations, three measures of line items."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, features, masks, modes, solvers, standardize

LEAST_FRACTION = 0.95
COMPONENTS = ("u", "v", "eta")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, area): nations, weighed by their suppliers. A made-up position serves the geometric queries."""
    return read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("cell")).agg(F.count(F.lit(1)).cast("double").alias("area"))


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, cell, u, v, eta): month index, nation, mean quantity, price in thousands, discount. One pass, suppliers broadcast by size."""
    items = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount")
    own = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("cell"))
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).cast("long")
    return items.join(own, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(month.alias("t"), "cell").agg(
        F.avg("l_quantity").alias("u"), (F.avg("l_extendedprice") / 1000).alias("v"), F.avg("l_discount").alias("eta")
    )


def fractions(spark: SparkSession, sf_dir: str, data: DataFrame | None = None) -> DataFrame:
    """(cell, fraction): how many of all months a nation has."""
    data = cube(spark, sf_dir) if data is None else data
    marked = data.withColumn("ok", masks.triplet_valid(COMPONENTS, None))
    n = data.agg(F.countDistinct("t")).first()[0]
    return masks.cell_fraction(marked, n, "cell")


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cube rows of cells that are valid often enough, at times at which all of them are there."""
    data = cube(spark, sf_dir).persist()  # three passes follow
    kept = fractions(spark, sf_dir, data).where(F.col("fraction") >= LEAST_FRACTION).select("cell")
    own = data.join(kept, "cell", "left_semi")
    n = kept.count()
    return own.join(masks.complete_times(own, "t", "u", n), "t", "left_semi")


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, cell, component, x)."""
    return features.unpivot(prepared(spark, sf_dir), ("t", "cell"), COMPONENTS)


def anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, cell, component, mean, anomaly, weight, feature_group): weight is the root of the area."""
    own = standardize.anomalies(long(spark, sf_dir), "x", "cell", "component")
    return own.join(cells(spark, sf_dir), "cell").withColumn("weight", F.sqrt("area")).withColumn("feature_group", (F.col("component") == "eta").cast("int"))


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anomalies over their group's RMS, by the root of the area: x; and scale."""
    own = anomaly(spark, sf_dir).drop("x").persist()  # its scales, then itself
    return standardize.scaled(own, standardize.group_scales(own))


def with_ids(df: DataFrame) -> DataFrame:
    """Adds feature_id: u, v, eta, each by cell; from the cells alone, a few rows."""
    ids = features.feature_map(df.select("component", F.lit(0).alias("row"), F.col("cell").alias("col")).distinct()).select("component", F.col("col").alias("cell"), "feature_id")
    return df.join(F.broadcast(ids), ["component", "cell"])


@dataclass(frozen=True)
class Solved:
    svd: solvers.Svd
    axis: np.ndarray
    features: DataFrame
    matrix: blocks.BlockMatrix


def solve(spark: SparkSession, sf_dir: str, requested: int = 100, solver: str = "covariance") -> Solved:
    """The decomposition of the scaled cube, signed by the first cell's loadings."""
    rows = with_ids(scaled(spark, sf_dir)).persist()  # features, axis and matrix are drawn from it
    feats = rows.select("feature_id", "component", "cell", "mean", "scale").distinct()
    axis = np.array(sorted(r[0] for r in rows.select("t").distinct().collect()), dtype=np.int64)
    n = feats.count()
    index = spark.createDataFrame(list(enumerate(axis.tolist())), "t_idx long, t long")
    matrix = blocks.kept(blocks.to_blocks(rows.join(F.broadcast(index), "t"), n, len(axis), 32))
    svd = solvers.by_covariance(matrix, requested) if solver == "covariance" else solvers.direct(matrix, requested)
    third = n // 3
    flips, _ = modes.signs(svd.u, [("u", 0), ("v", third), ("eta", 2 * third)])
    return Solved(svd.flipped(flips), axis, feats, matrix)


__all__ = ["Solved", "anomaly", "cells", "cube", "fractions", "long", "prepared", "read", "scaled", "solve", "with_ids"]
