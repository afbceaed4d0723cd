"""From unstructured profiles to a regular grid: vertical brackets, then barycentric weights."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite

NEAR = 16 * sys.float_info.epsilon


def brackets(df: DataFrame, targets: dict[str, float], keys: tuple[str, ...], z: str = "z", layer: str = "layer", values: tuple[str, ...] = ("u", "v")) -> DataFrame:
    """For each column of the water and each target, the usable layers next below and above, by one aggregation.

    Layers may stand in any order. Of equal heights the lowest layer number wins. All targets share one pass.
    """
    usable = finite(z)
    for v in values:
        usable = usable & finite(v)
    payload = [F.col(v) for v in values]
    aggs = []
    for name, target in targets.items():
        aggs.append(F.max(F.when(F.col(z) <= target, F.struct(F.col(z).alias("z"), (-F.col(layer)).alias("rank"), *payload))).alias(f"{name}_below"))
        aggs.append(F.min(F.when(F.col(z) >= target, F.struct(F.col(z).alias("z"), F.col(layer).alias("rank"), *payload))).alias(f"{name}_above"))
    return df.where(usable).groupBy(*keys).agg(*aggs)


def between(name: str, target: float, value: str) -> Column:
    """The value at the target: linear within the bracket, the lower layer's where both meet, null without a bracket."""
    a, b = F.col(f"{name}_below"), F.col(f"{name}_above")
    span = b["z"] - a["z"]
    return F.when(F.abs(span) <= NEAR, a[value]).otherwise(a[value] + (F.lit(target) - a["z"]) / span * (b[value] - a[value]))


def at_depths(df: DataFrame, targets: dict[str, float], keys: tuple[str, ...], z: str = "z", layer: str = "layer", values: tuple[str, ...] = ("u", "v")) -> DataFrame:
    """keys, level, the values at each target, and span (the bracket's height). No extrapolation: rows without a bracket have nulls."""
    found = brackets(df, targets, keys, z, layer, values)
    rows = [
        F.struct(F.lit(name).alias("level"), *(between(name, target, v).alias(v) for v in values), (F.col(f"{name}_above.z") - F.col(f"{name}_below.z")).alias("span"))
        for name, target in targets.items()
    ]
    return found.select(*keys, F.explode(F.array(*rows)).alias("x")).select(*keys, "x.*")


def barycentric(nodes: DataFrame, mesh: DataFrame, keys: tuple[str, ...], values: tuple[str, ...] = ("u", "v")) -> DataFrame:
    """Weighted sums over a cell's three vertices; null unless all three have a node, a finite weight and finite values.

    ``mesh`` (row, col, slot, node, weight) has three rows per cell. It is joined on the node, so only needed nodes are read.
    """
    joined = mesh.where("node >= 0").join(nodes, "node")
    aggs = []
    for v in values:
        good = finite(v) & finite("weight")
        aggs.append(F.when(F.count_if(good) == 3, F.sum(F.when(good, F.col("weight") * F.col(v)))).alias(v))
    return joined.groupBy("row", "col", *keys).agg(*aggs)


def needed_nodes(nodes: DataFrame, mesh: DataFrame) -> DataFrame:
    """Only nodes that some cell refers to."""
    return nodes.join(mesh.where("node >= 0").select("node").distinct(), "node", "left_semi")


def island_count(numbers: DataFrame, column: str) -> int:
    """Runs of consecutive numbers: rows whose predecessor is absent. A join instead of a global window."""
    own = numbers.select(F.col(column).alias("x")).distinct()
    return own.join(own.select((F.col("x") + 1).alias("x")), "x", "left_anti").count()
