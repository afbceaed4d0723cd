"""Which cells, times and features take part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import require
from ..functions.scalar import distance2, finite

EDGE = 1e-10


def snap_axis(axis: DataFrame, value: str, place: str, low: float, high: float) -> tuple[int, int]:
    """First and end place of the axis window around [low, high], one step outwards. The axis has one row per place."""
    r = axis.agg(F.max(F.when(F.col(value) <= low, F.col(place))).alias("a"), F.min(F.when(F.col(value) >= high, F.col(place))).alias("b"), F.min(place).alias("first"), F.max(place).alias("last"), F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    require(low < high, "an empty box")
    require(high >= r["lo"] and low <= r["hi"], "the box lies outside of the axis")
    start = r["a"] if r["a"] is not None else r["first"]
    stop = r["b"] if r["b"] is not None else r["last"]
    return int(start), int(stop) + 1


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a cell's centre lies in the closed box (lon_min, lon_max, lat_min, lat_max)."""
    return lon.between(box[0] - EDGE, box[1] + EDGE) & lat.between(box[2] - EDGE, box[3] + EDGE)


def geometry(grid: DataFrame, box: tuple[float, float, float, float], policy: str = "analysis_bbox_cell_center") -> DataFrame:
    """Adds ``inside``: all cells of a reader's window, or those whose centre is in the box."""
    require(policy in ("reader_window", "analysis_bbox_cell_center"), f"unknown policy {policy}")
    return grid.withColumn("inside", F.lit(True) if policy == "reader_window" else in_box(F.col("lon"), F.col("lat"), box))


def triplet_valid(values: tuple[str, ...] = ("u", "v", "eta"), valid: str | None = "valid") -> Column:
    ok = F.coalesce(F.col(valid), F.lit(False)) if valid else F.lit(True)
    for c in values:
        ok = ok & finite(c)
    return ok


def jointly_null(df: DataFrame, values: tuple[str, ...] = ("u", "v", "eta"), valid: str | None = "valid") -> DataFrame:
    """All values of a row count or none; adds ``ok``."""
    out = df.withColumn("ok", triplet_valid(values, valid))
    return out.withColumns({c: F.when(F.col("ok"), F.col(c)) for c in values})


def cell_fraction(df: DataFrame, n_times: int, *cell: str, ok: str = "ok") -> DataFrame:
    """Share of the axis' times at which a cell is valid; absent rows count as missing, hence the axis' length."""
    return df.groupBy(*cell).agg((F.count_if(F.col(ok)) / F.lit(n_times)).alias("fraction"))


def enough(fractions: DataFrame, least: float, least_cells: int) -> DataFrame:
    out = fractions.where(F.col("fraction") >= least)
    n = out.count()
    require(n >= least_cells, f"{n} cells are valid often enough, {least_cells} are needed")
    return out


def complete_times(df: DataFrame, time: str, value: str, n_features: int) -> DataFrame:
    """Times at which every feature has a value."""
    return df.groupBy(time).agg(F.count(value).alias("n")).where(F.col("n") == n_features).select(time)


def retained(n_kept: int, n_all: int, least: float, least_times: int = 2) -> float:
    share = n_kept / n_all if n_all else 0.0
    require(share >= least, f"{share:.3%} of the times are complete, {least:.3%} are needed")
    require(n_kept >= least_times, f"{n_kept} complete times, {least_times} are needed")
    return share


def static_candidates(grid: DataFrame, levels: DataFrame) -> DataFrame:
    """(level, row, col) that may hold a value: cells inside and at sea; below the surface also supported and deep enough.

    ``levels`` (level, depth_m, weight_m) is a handful of rows, so the cross join is bounded by the grid.
    """
    both = grid.crossJoin(F.broadcast(levels))
    deep = (F.col("level") == 0) | (F.col("supported") & finite("bathymetry") & (F.col("bathymetry") >= F.col("depth_m")))
    return both.where(F.col("inside") & F.col("static") & deep)


def paired_selection(fractions: DataFrame, least: float) -> DataFrame:
    """Features (component, level, row, col, fraction) that stay: u and v of a level and cell only together, eta alone."""
    w = W.partitionBy(F.when(F.col("component") == "eta", "eta").otherwise("uv"), "level", "row", "col")
    return fractions.withColumn("both", F.min("fraction").over(w)).withColumn("n", F.count(F.lit(1)).over(w)).where((F.col("both") >= least) & ((F.col("component") == "eta") | (F.col("n") == 2))).drop("both", "n")


def supported_cells(mesh: DataFrame) -> DataFrame:
    """(row, col) with three vertices that exist and have finite weights."""
    return mesh.groupBy("row", "col").agg(F.count_if((F.col("node") >= 0) & finite("weight")).alias("n")).where("n = 3").select("row", "col")


def nearest(cells: DataFrame, lon0: float, lat0: float) -> DataFrame:
    """The cell nearest to a point; the first in row order of equals. A top-1, not a sort."""
    return cells.withColumn("d2", distance2(F.col("lon"), F.col("lat"), lon0, lat0)).orderBy("d2", "row", "col").limit(1)


def eligible(status: str, kind: str, *, allow_partial: bool = False, allow_trial: bool = False, required: frozenset[str] = frozenset({"standard_month"})) -> bool:
    """Whether a month with this status and kind may be read."""
    if allow_trial and (status, kind) == ("trial_ready", "trial_partial_month"):
        return True
    kinds = set(required) | ({"standard_partial_month"} if allow_partial else set())
    return status == "ready" and kind in kinds


#: Share of a map's width and height at each edge that holds no arrows.
ARROW_MARGIN = 0.06


def map_extent(cells: DataFrame, box: tuple[float, float, float, float], lon_step: float, lat_step: float) -> tuple[float, float, float, float]:
    """What a map shows: the outer edges of its cells, within the box."""
    e = cells.agg(F.min("lon").alias("a"), F.max("lon").alias("b"), F.min("lat").alias("c"), F.max("lat").alias("d")).first()
    require(e["a"] is not None, "a map without cells")
    return max(box[0], e["a"] - lon_step / 2), min(box[1], e["b"] + lon_step / 2), max(box[2], e["c"] - lat_step / 2), min(box[3], e["d"] + lat_step / 2)


def thinned(df: DataFrame, step: int, extent: tuple[float, float, float, float], u: str = "u", v: str = "v") -> DataFrame:
    """Arrows of a map that shows ``extent``: every ``step``-th row and column with finite components, away from the edges."""
    lon, lat = ARROW_MARGIN * (extent[1] - extent[0]), ARROW_MARGIN * (extent[3] - extent[2])
    inner = (F.col("lon") >= extent[0] + lon) & (F.col("lon") <= extent[1] - lon) & (F.col("lat") >= extent[2] + lat) & (F.col("lat") <= extent[3] - lat)
    return df.where((F.col("row") % step == 0) & (F.col("col") % step == 0) & finite(u) & finite(v) & inner)
