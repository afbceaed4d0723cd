"""Water-column modes: six velocity levels and one surface height in one matrix, solved directly."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import require
from ..operators import blocks, features, masks, modes, regrid, solvers, standardize, timeaxis
from ..sources import arrays, runs
from ..sources.config import LEVEL_DEPTHS, LEVEL_IDS, ColumnConfig


@dataclass(frozen=True)
class Selected:
    """values: (t_idx, component, level, row, col, x) complete; layout adds weight, group and feature_id to (component, level, row, col)."""

    values: DataFrame
    layout: DataFrame
    axis: np.ndarray
    fractions: DataFrame
    policy: str
    report: dict


def levels(spark: SparkSession, config: ColumnConfig) -> DataFrame:
    return spark.createDataFrame([(i, LEVEL_IDS[i], d, w) for i, (d, w) in enumerate(zip(LEVEL_DEPTHS, config.weights, strict=True))], "level int, level_id string, depth_m double, weight_m double")


def paired(surface: list[arrays.Month], native: list[arrays.Month], surface_axis: DataFrame, native_axis: DataFrame) -> None:
    """Both caches hold the same months of one configuration, at the same times."""
    for a, b in zip(surface, native, strict=True):
        require(a.month == b.month and a.kind == b.kind, f"{a.month}: the caches differ in kind")
        require(a.metadata.get("config_hash") == b.metadata.get("config_hash"), f"{a.month}: the caches differ in configuration")
    keys = ["month", "src", "t"]
    odd = surface_axis.select(*keys).join(native_axis.select(*keys).withColumn("there", F.lit(1)), keys, "full").join(surface_axis.select(*keys).withColumn("here", F.lit(1)), keys, "left").where("here is null or there is null")
    require(odd.isEmpty(), "the caches' time axes differ")


def candidate_values(surface: DataFrame, native: DataFrame, mesh: DataFrame, candidates: DataFrame, axis: DataFrame) -> DataFrame:
    """(t, component, level, row, col, x) of candidate features that have a value; rounded to single precision, as they are stored.

    ``axis`` (t, ordinal, src) drops time steps before the wide scans. The five depths come from one pass over the native layers.
    Surface currents are masked by their validity; surface height is not.
    """
    few = axis
    top = surface.join(few, ["ordinal", "src"])
    masked = [F.when(F.coalesce("valid", F.lit(False)), F.col(c)).alias(c) for c in ("u", "v")]
    flat = features.unpivot(top.select("t", "row", "col", *masked, "eta"), ("t", "row", "col"), ("u", "v", "eta")).withColumn("level", F.when(F.col("component") == "eta", -1).otherwise(0))
    targets = {name: -depth for name, depth in zip(LEVEL_IDS[1:], LEVEL_DEPTHS[1:], strict=True)}
    deep = regrid.at_depths(native.join(few, ["ordinal", "src"]), targets, ("t", "node")).drop("span").where("u is not null")
    on_grid = regrid.barycentric(deep, mesh, ("t", "level"))
    number = F.element_at(F.create_map(*(x for i, n in enumerate(LEVEL_IDS) for x in (F.lit(n), F.lit(i)))), F.col("level"))
    below = features.unpivot(on_grid.withColumn("level", number), ("t", "level", "row", "col"), ("u", "v"))
    both = flat.select("t", "component", "level", "row", "col", "x").unionByName(below.select("t", "component", "level", "row", "col", "x"))
    kept = both.join(candidates.select("component", "level", "row", "col"), ["component", "level", "row", "col"], "left_semi")
    return kept.where("x is not null").withColumn("x", F.col("x").cast("float").cast("double"))


def candidates(grid: DataFrame, mesh: DataFrame, lv: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """(component, level, row, col, weight, feature_group) that can hold a value; eta has level -1. Cells of a grid times six."""
    supported = masks.supported_cells(mesh).withColumn("supported", F.lit(True))
    own = masks.geometry(grid, box).join(supported, ["row", "col"], "left").na.fill(False, ["supported"])
    velocity = masks.static_candidates(own, lv).select("level", "row", "col", F.sqrt(F.col("area") * F.col("weight_m")).alias("weight"), F.lit(0).alias("feature_group"))
    pairs = velocity.crossJoin(F.broadcast(grid.sparkSession.createDataFrame([("u",), ("v",)], "component string")))
    eta = own.where("inside and static").select(F.lit(-1).alias("level"), "row", "col", F.sqrt("area").alias("weight"), F.lit(1).alias("feature_group"), F.lit("eta").alias("component"))
    return pairs.unionByName(eta)


def select(values: DataFrame, layout: DataFrame, times: DataFrame, config: ColumnConfig) -> Selected:
    """Features present often enough and the times at which all of them are; if too few times are left, only features that are always present."""
    spark = values.sparkSession
    keys = ["component", "level", "row", "col"]
    n = times.count()
    counted = values.groupBy(*keys).agg(F.count("x").alias("n"))
    fractions = layout.join(counted, keys, "left").select(*keys, "weight", "feature_group", (F.coalesce("n", F.lit(0)) / F.lit(n)).alias("fraction"))

    def choose(least: float) -> tuple[DataFrame, DataFrame, int]:
        own = masks.paired_selection(fractions, least)
        k = own.count()
        return own, masks.complete_times(values.join(own.select(*keys), keys, "left_semi"), "t", "x", k), k

    policy = "configured_minimum_feature_valid_fraction"
    own, whole, k = choose(config.least_feature_fraction)
    kept = whole.count() if k else 0
    if kept / n < config.least_time_fraction:
        policy = "complete_feature_fallback_after_time_intersection_loss"
        own, whole, k = choose(1.0)
        kept = whole.count() if k else 0
    share = masks.retained(kept, n, config.least_time_fraction, config.modes)
    cells = {(r["component"], r["level"]): r["n"] for r in own.groupBy("component", "level").agg(F.count(F.lit(1)).alias("n")).collect()}
    require(cells.get(("eta", -1), 0) >= config.least_eta_cells, "too few cells with surface height")
    for i, name in enumerate(LEVEL_IDS):
        require(cells.get(("u", i), 0) >= config.least_level_cells, f"too few cells at {name}")
    axis = np.array(sorted(r[0] for r in whole.collect()), dtype=np.int64)
    index = spark.createDataFrame(list(enumerate(axis.tolist())), "t_idx long, t long")
    final = features.feature_map(own, features.COLUMN_ORDER)
    chosen = values.join(index, "t").join(own.select(*keys), keys, "left_semi")
    report = {"candidate_features": fractions.count(), "features": k, "times": n, "retained_times": kept, "retained_time_fraction": share, "policy": policy, "cells_per_level": {f"{c}:{lv}": m for (c, lv), m in sorted(cells.items())}}
    return Selected(chosen, final, axis, fractions, policy, report)


@dataclass(frozen=True)
class Solved:
    svd: solvers.Svd
    features: DataFrame
    velocity_rms: float
    eta_rms: float
    sign_sources: list[str]


def solve(s: Selected, grid: DataFrame, config: ColumnConfig) -> Solved:
    keys = ["component", "level", "row", "col"]
    anomaly = standardize.anomalies(s.values, "x", *keys).drop("x").join(s.layout.select(*keys, "weight", "feature_group", "feature_id"), keys)
    rms = {r["feature_group"]: r["rms"] for r in standardize.group_scales(anomaly).collect()}
    scales = anomaly.sparkSession.createDataFrame(sorted(rms.items()), "feature_group int, rms double")  # known: not another pass over the cube
    rows = standardize.scaled(anomaly, scales)
    feats = rows.groupBy("feature_id", *keys).agg(F.first("mean").alias("mean"), F.first("scale").alias("scale"))
    matrix = blocks.kept(blocks.to_blocks(rows, s.report["features"], len(s.axis), config.block_times))
    svd = solvers.direct(matrix, config.modes, config.least_modes, config.memory_bytes, config.tolerance, attempts=config.attempts, seed=config.seed)
    anchors = []
    for c, lv in (("u", 0), ("v", 0), ("eta", -1)):  # each has its own nearest feature
        near = masks.nearest(s.layout.where((F.col("component") == c) & (F.col("level") == lv)).join(grid.select("row", "col", "lon", "lat"), ["row", "col"]), *config.centre).select("feature_id").first()
        if near:
            anchors.append((f"centre_{c}_loading", int(near[0])))
    flips, why = modes.signs(svd.u, anchors)
    return Solved(svd.flipped(flips), feats, float(rms[0]), float(rms[1]), why)


def result_tables(spark: SparkSession, s: Selected, r: Solved, grid: DataFrame, lv: DataFrame) -> dict[str, DataFrame]:
    loadings = modes.loadings_table(spark, r.svd.u)
    pcs = modes.coefficients_table(spark, r.svd.pc, s.axis)
    return {
        "spectrum": modes.spectrum_table(spark, r.svd),
        "modes": modes.regression(modes.physical(loadings, r.features), pcs),
        "pc": pcs,
        "features": r.features,
        "fractions": s.fractions,
        "cells": grid,
        "levels": lv,
    }


def run(spark: SparkSession, config: ColumnConfig, native_root: str, surface_root: str, output_root: str, *, allow_partial: bool = False, allow_trial: bool = False, resume: str | None = None) -> str:
    """The published folder. If the solver fails, what it was given stays in a recovery folder that ``resume`` names."""
    final = f"{output_root}/water_column_svd/{config.label}"
    require(not runs.exists(spark, final), f"{final} exists")
    watch, lv = runs.Stopwatch(), levels(spark, config)
    grid = arrays.grid(spark, surface_root, config.domain)
    recovery = resume or f"{output_root}/water_column_svd/.{config.label}.recovery"
    key = {"science": runs.science_hash(config.raw)}
    if resume:
        kept = runs.Checkpoint(spark, recovery).load(key)
        axis = np.array(sorted(r[0] for r in kept["axis"].collect()), dtype=np.int64)
        meta = kept["report"].first()
        s = Selected(kept["values"], kept["layout"], axis, kept["fractions"], meta["policy"], {"features": meta["features"], "policy": meta["policy"], "resumed": True})
        months = []
    else:
        allow = {"allow_partial": allow_partial, "allow_trial": allow_trial, "required": config.input.required_kinds, "schema_major": config.input.schema_major}
        with watch.measure("sources"):
            months = arrays.months(surface_root, config.domain, config.input.month_ids, **allow)
            deep = arrays.months(native_root, config.domain, config.input.month_ids, **allow)
            axis_rows = arrays.axis(spark, surface_root, config.domain, months)
            paired(months, deep, axis_rows, arrays.axis(spark, native_root, config.domain, deep))
            placed = axis_rows.withColumn("place", F.col("ordinal").cast("long") * F.lit(1 << 32) + F.col("src"))
            canonical, done = timeaxis.canonicalize(placed, config.input.policy, "t", "place")
            timeaxis.validate_cadence(canonical, config.input.step_hours, config.input.maximum_gap_hours)
            times = canonical.join(placed.select("place", "ordinal", "src"), "place").select("t", "ordinal", "src")
            mesh = arrays.mesh(spark, surface_root, config.domain)
            layout = candidates(grid, mesh, lv, config.box)
            inside = layout.where("level > 0").select("row", "col").distinct()
            nodes = [r[0] for r in mesh.where("node >= 0").join(inside, ["row", "col"], "left_semi").select("node").distinct().collect()]
            values = candidate_values(arrays.surface(spark, surface_root, config.domain, months), arrays.native(spark, native_root, config.domain, deep, nodes), mesh, layout, times)
        folder = f"{recovery}-{runs.science_hash(config.raw)[:8]}"
        with watch.measure("selection"):
            values = values.persist(StorageLevel.DISK_ONLY)
            s = select(values, layout, times, config)
    try:
        with watch.measure("solver"):
            r = solve(s, grid, config)
    except Exception:
        if not resume and not runs.exists(spark, folder):
            spark_axis = spark.createDataFrame([(int(t),) for t in s.axis], "t long")
            report = spark.createDataFrame([(s.policy, s.report["features"])], "policy string, features long")
            runs.Checkpoint(spark, folder).save(key, {"values": s.values, "layout": s.layout, "fractions": s.fractions, "axis": spark_axis, "report": report})
        raise
    status = "trial_pilot" if any(m.kind == "trial_partial_month" for m in months) else "flow_domain_pilot_complete"

    def write(path: str) -> None:
        runs.write_tables(path, result_tables(spark, s, r, grid, lv))
        runs.write_json(spark, f"{path}/config.json", config.raw)
        runs.write_json(
            spark,
            f"{path}/metadata.json",
            {
                "kind": "water_column", "status": status, "label": config.label, "domain": config.domain, "months": [[m.month, m.kind, m.digest] for m in months], "selection": s.report,
                "velocity_rms": r.velocity_rms, "eta_rms": r.eta_rms, "mode_count": len(r.svd.s), "solver": r.svd.solver, "left_residual": r.svd.left_residual, "right_residual": r.svd.right_residual,
                "orthogonality": r.svd.orthogonality, "attempts": r.svd.attempts, "retained_error": r.svd.retained_error, "total_sum_squares": r.svd.total, "sign_sources": r.sign_sources, "seconds": watch.seconds,
            },
        )

    return runs.publish(spark, final, write)


def preflight(spark: SparkSession, config: ColumnConfig, native_root: str, surface_root: str, **allow: bool) -> dict:
    """Pairing, time axis, candidate features and the memory a dense solver would need, from headers; nothing is written."""
    allow = {**allow, "required": config.input.required_kinds, "schema_major": config.input.schema_major}
    top = arrays.months(surface_root, config.domain, config.input.month_ids, **allow)
    deep = arrays.months(native_root, config.domain, config.input.month_ids, **allow)
    axis = arrays.axis(spark, surface_root, config.domain, top)
    paired(top, deep, axis, arrays.axis(spark, native_root, config.domain, deep))
    placed = axis.withColumn("place", F.col("ordinal").cast("long") * F.lit(1 << 32) + F.col("src"))
    _, done = timeaxis.canonicalize(placed, config.input.policy, "t", "place")
    mesh = arrays.mesh(spark, surface_root, config.domain)
    n = candidates(arrays.grid(spark, surface_root, config.domain), mesh, levels(spark, config), config.box).count()
    nodes = mesh.where("node >= 0").select("node").distinct()
    return {"months": len(top), "times": done.rows_out, "candidate_features": n, "nodes": nodes.count(), "node_runs": regrid.island_count(nodes, "node"), "matrix_bytes": 8 * n * done.rows_out, "dense_bytes": solvers.dense_bytes(n, done.rows_out)}
