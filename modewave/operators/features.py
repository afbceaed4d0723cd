"""The order of features, and the way back to the grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Orders of components in a state vector.
SURFACE_ORDER = ("u", "v", "eta")
COLUMN_ORDER = ("eta", "u", "v")


def rank_of(component: Column, order: tuple[str, ...]) -> Column:
    out = F.lit(len(order))
    for i, c in enumerate(order):
        out = F.when(component == c, i).otherwise(out)
    return out


def feature_map(features: DataFrame, order: tuple[str, ...] = SURFACE_ORDER) -> DataFrame:
    """Adds ``feature_id``: by component, level, row, column. One row per feature, so the global window is over the grid, not the series."""
    cols = ["level", "row", "col"] if "level" in features.columns else ["row", "col"]
    return features.withColumn("feature_id", (F.row_number().over(W.orderBy(rank_of(F.col("component"), order), *cols)) - 1).cast("long"))


def unpivot(wide: DataFrame, keys: tuple[str, ...], components: tuple[str, ...] = SURFACE_ORDER) -> DataFrame:
    """From a column per component to (keys, component, x)."""
    rows = F.array(*(F.struct(F.lit(c).alias("component"), F.col(c).cast("double").alias("x")) for c in components))
    return wide.select(*keys, F.explode(rows).alias("y")).select(*keys, "y.component", "y.x")


def on_grid(grid: DataFrame, values: DataFrame, features: DataFrame, value: str) -> DataFrame:
    """(mode, component, [level,] row, col, value) for every cell of the grid and every feature kind; absent ones are null."""
    keys = ["component", *(["level"] if "level" in features.columns else [])]
    kinds = features.select(*keys).distinct()
    modes = values.select("mode").distinct()
    full = grid.select("row", "col").crossJoin(F.broadcast(kinds)).crossJoin(F.broadcast(modes))
    placed = values.join(features, "feature_id").select("mode", *keys, "row", "col", value)
    return full.join(placed, ["mode", *keys, "row", "col"], "left")


def pair_mask(grid: DataFrame, features: DataFrame) -> DataFrame:
    """Cells of the grid with the number of features that each component has there: the coverage map."""
    n = features.groupBy("row", "col").pivot("component", list(COLUMN_ORDER)).agg(F.count(F.lit(1)))
    return grid.select("row", "col").join(n, ["row", "col"], "left").na.fill(0)
