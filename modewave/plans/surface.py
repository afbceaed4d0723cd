"""Surface modes of one region: read, repair, mask, fill, solve, publish."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import require
from ..operators import blocks, features, gapfill, masks, modes, solvers, standardize, timeaxis
from ..sources import arrays, runs
from ..sources.config import SurfaceConfig

TIMES_PER_BLOCK = 256
ROWS_PER_TASK = 100_000


@dataclass(frozen=True)
class Prepared:
    """state: (t, t_idx, row, col, u, v, eta, imputed) complete over the kept cells and times; cells: (row, col, lon, lat, area, fraction)."""

    state: DataFrame
    cells: DataFrame
    axis: np.ndarray
    all_cells: DataFrame
    report: dict


def packed(df: DataFrame, rows: int) -> DataFrame:
    """A table to be kept, in as many partitions as its rows need: what is kept stays in those that its last shuffle made, and each pass over it pays for them."""
    return df.coalesce(max(1, -(-rows // ROWS_PER_TASK)))


def window(grid: DataFrame, config: SurfaceConfig) -> tuple[int, int, int, int]:
    a, b, c, d = config.box
    cols = masks.snap_axis(grid.select("col", "lon").distinct(), "lon", "col", a, b)
    rows = masks.snap_axis(grid.select("row", "lat").distinct(), "lat", "row", c, d)
    return rows[0], rows[1], cols[0], cols[1]


def prepare(cube: DataFrame, axis: DataFrame, grid: DataFrame, config: SurfaceConfig) -> Prepared:
    """``cube`` (month, ordinal, src, row, col, u, v, eta, valid), ``axis`` (month, ordinal, src, t), ``grid`` of the window.

    Absent rows count as missing. Time steps that the axis drops are dropped before anything else is done with the cube.
    """
    own, n_repaired = timeaxis.repair(axis, list(config.input.repairs))
    own = own.withColumn("place", F.col("ordinal").cast("long") * F.lit(1 << 32) + F.col("src")).persist(StorageLevel.MEMORY_AND_DISK)  # order, cadence and cube ask for it
    canonical, done = timeaxis.canonicalize(own, config.input.policy, "t", "place")
    cadence = timeaxis.validate_cadence(canonical, config.input.step_hours, config.input.maximum_gap_hours)
    n = done.rows_out
    kept_axis = canonical.join(own.select("place", "ordinal", "src"), "place").select("t", "ordinal", "src")
    timed = masks.jointly_null(cube.join(kept_axis, ["ordinal", "src"]))
    inside = masks.geometry(grid, config.box, config.mask_policy)
    fractions = masks.cell_fraction(timed, n, "row", "col")
    all_cells = inside.join(fractions, ["row", "col"], "left").na.fill(0.0, ["fraction"])
    cells = masks.enough(all_cells.where("inside and static"), config.least_cell_fraction, config.least_cells)
    few = cells.select("row", "col")
    part = timed.join(few, ["row", "col"], "left_semi").select("t", "row", "col", "u", "v", "eta")
    full = gapfill.dense(part, kept_axis.select("t"), cells.select("row", "col"))
    filled = gapfill.fill_short_gaps(full, ("u", "v", "eta"), config.max_gap_steps, ("row", "col"))
    n_cells = cells.count()
    whole = masks.complete_times(filled, "t", "u", n_cells)
    times = np.array(sorted(r[0] for r in whole.collect()), dtype=np.int64)
    share = masks.retained(len(times), n, config.least_time_fraction)
    index = cube.sparkSession.createDataFrame(list(enumerate(times.tolist())), "t_idx long, t long")
    report = {
        "initial_time_count": n, "retained_time_count": len(times), "retained_time_fraction": share, "repaired_time_step_count": n_repaired, "common_ocean_cell_count": n_cells,
        "canonicalization": {"policy": done.policy, "rows_in": done.rows_in, "rows_out": done.rows_out, "reordered": done.reordered, "dropped": done.dropped},
        "cadence": {"median_hours": cadence.median_hours, "maximum_gap_hours": cadence.maximum_hours, "gap_break_count": cadence.breaks},
    }
    return Prepared(packed(filled.join(index, "t"), n_cells * n).persist(StorageLevel.MEMORY_AND_DISK), cells, times, all_cells, report)


@dataclass(frozen=True)
class Solved:
    """features: (feature_id, component, row, col, mean, scale); svd signed at the anchor."""

    svd: solvers.Svd
    features: DataFrame
    velocity_rms: float
    eta_rms: float
    sign_sources: list[str]
    matrix: blocks.BlockMatrix


def solve(p: Prepared, config: SurfaceConfig) -> Solved:
    long = features.unpivot(p.state, ("t_idx", "row", "col"))
    anomaly = standardize.anomalies(long, "x", "component", "row", "col")
    weighted = anomaly.join(p.cells.select("row", "col", F.sqrt("area").alias("weight")), ["row", "col"]).withColumn("feature_group", (F.col("component") == "eta").cast("int")).drop("x")
    rms = {r["feature_group"]: r["rms"] for r in standardize.group_scales(weighted).collect()}
    scales = p.state.sparkSession.createDataFrame(sorted(rms.items()), "feature_group int, rms double")  # known: not another pass over the cube
    ids = features.feature_map(p.cells.select("row", "col").crossJoin(F.broadcast(p.cells.sparkSession.createDataFrame([(c,) for c in features.SURFACE_ORDER], "component string"))))
    rows = standardize.scaled(weighted, scales).join(ids, ["component", "row", "col"])
    n_cells = p.report["common_ocean_cell_count"]
    feats = rows.groupBy("feature_id", "component", "row", "col").agg(F.first("mean").alias("mean"), F.first("scale").alias("scale"))
    feats = packed(feats, 3 * n_cells).persist(StorageLevel.MEMORY_AND_DISK)  # a row per feature, for two tables and all that is drawn from them
    matrix = blocks.kept(blocks.to_blocks(rows, 3 * n_cells, len(p.axis), TIMES_PER_BLOCK))
    svd = solvers.by_covariance(matrix, config.modes, config.least_modes)
    anchor = masks.nearest(p.cells, *config.anchor).join(ids, ["row", "col"]).select("component", "feature_id").collect()
    at = {r["component"]: r["feature_id"] for r in anchor}
    flips, why = modes.signs(svd.u, [(f"anchor_{c}_loading", at[c]) for c in features.SURFACE_ORDER])
    return Solved(svd.flipped(flips), feats, float(rms[0]), float(rms[1]), why, matrix)


def result_tables(spark: SparkSession, p: Prepared, s: Solved) -> dict[str, DataFrame]:
    loadings = modes.loadings_table(spark, s.svd.u)
    pcs = modes.coefficients_table(spark, s.svd.pc, p.axis)
    physical = modes.regression(modes.physical(loadings, s.features), pcs)
    return {
        "spectrum": modes.spectrum_table(spark, s.svd),
        "full_spectrum": spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(s.svd.shares)], "mode int, ev double"),
        "modes": physical,
        "pc": pcs,
        "features": s.features,
        "cells": p.all_cells,
        "imputed": p.state.where("imputed").select("t", "row", "col"),
    }


def run(spark: SparkSession, config: SurfaceConfig, surface_root: str, output_root: str, *, allow_partial: bool = False, allow_trial: bool = False, parquet: bool = False) -> str:
    """The published folder of a region's run: tables, configuration, metadata. With ``parquet`` the root holds tables (see ``arrays.export``) on any store."""
    watch = runs.Stopwatch()
    allow = {"allow_partial": allow_partial, "allow_trial": allow_trial, "required": config.input.required_kinds, "schema_major": config.input.schema_major}
    with watch.measure("sources"):
        found = (arrays.exported_months(spark, surface_root, config.domain, config.input.month_ids, **allow) if parquet else arrays.months(surface_root, config.domain, config.input.month_ids, **allow))
        name = runs.run_id(config.label, config.raw, [(m.month, m.digest) for m in found])
        final = f"{output_root}/svd/{name}"
        require(not runs.exists(spark, final), f"{final} exists")
        grid = spark.read.parquet(f"{surface_root}/{config.domain}/grid") if parquet else arrays.grid(spark, surface_root, config.domain)
        r0, r1, c0, c1 = window(grid, config)
        own = grid.where(F.col("row").between(r0, r1 - 1) & F.col("col").between(c0, c1 - 1))
        if parquet:
            cube, axis = arrays.exported(spark, surface_root, config.domain, found, (r0, r1, c0, c1))
        else:
            cube, axis = arrays.surface(spark, surface_root, config.domain, found, (r0, r1, c0, c1)), arrays.axis(spark, surface_root, config.domain, found)
    with watch.measure("preparation"):
        p = prepare(cube, axis, own, config)
    with watch.measure("solver"):
        s = solve(p, config)
    status = "trial_pilot" if any(m.kind == "trial_partial_month" for m in found) else "candidate_pilot" if config.approval == "candidate" else "analysis_ready"

    def write(folder: str) -> None:
        with watch.measure("tables"):
            runs.write_tables(folder, result_tables(spark, p, s))
        runs.write_json(spark, f"{folder}/config.json", config.raw)
        runs.write_json(
            spark,
            f"{folder}/metadata.json",
            {
                "kind": "surface", "status": status, "run_id": name, "label": config.label, "region": config.region, "domain": config.domain, "months": [[m.month, m.kind, m.digest] for m in found],
                "window": [r0, r1, c0, c1], "preparation": p.report, "imputed_scalar_count": 3 * p.state.where("imputed").count(), "velocity_rms": s.velocity_rms, "eta_rms": s.eta_rms,
                "mode_count": len(s.svd.s), "rank": s.svd.rank, "sign_sources": s.sign_sources, "orthogonality": s.svd.orthogonality, "sum_ev": float(s.svd.shares.sum()),
                "retained_error": s.svd.retained_error, "seconds": watch.seconds,
            },
        )

    return runs.publish(spark, final, write)


def preflight(spark: SparkSession, config: SurfaceConfig, surface_root: str, **allow: bool) -> dict:
    """What a run would find, from headers and time axes alone; nothing is written."""
    found = arrays.months(surface_root, config.domain, config.input.month_ids, required=config.input.required_kinds, schema_major=config.input.schema_major, **allow)
    axis, moved = timeaxis.repair(arrays.axis(spark, surface_root, config.domain, found), list(config.input.repairs))
    axis = axis.withColumn("place", F.col("ordinal").cast("long") * F.lit(1 << 32) + F.col("src"))
    canonical, done = timeaxis.canonicalize(axis, config.input.policy, "t", "place")
    cadence = timeaxis.validate_cadence(canonical, config.input.step_hours, config.input.maximum_gap_hours)
    return {"months": len(found), "times": done.rows_out, "reordered": done.reordered, "dropped": done.dropped, "repaired": moved, "median_hours": cadence.median_hours, "maximum_gap_hours": cadence.maximum_hours, "breaks": cadence.breaks}
