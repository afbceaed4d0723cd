"""What is made from published runs, read-only: figure tables, host layout, reconstructions, region reports, batches."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import require
from ..functions.scalar import ev_class
from ..operators import features, masks, modes, stats, timeaxis
from ..sources import runs
from ..sources.config import LEVEL_DEPTHS, LEVEL_IDS, BatchConfig, surface_config


def validated(spark: SparkSession, run: str) -> dict[str, DataFrame]:
    """A run's tables, held against each other: modes, times and features agree, values are finite, the spectrum falls."""
    t = runs.read_tables(spark, run, "spectrum", "modes", "pc", "features", "cells")
    meta = runs.read_metadata(spark, run)
    k = meta["mode_count"]
    s = t["spectrum"].orderBy("mode").collect()
    require([r["mode"] for r in s] == list(range(1, k + 1)), "the spectrum's modes")
    require(all(a["sigma"] >= b["sigma"] for a, b in zip(s, s[1:], strict=False)), "the spectrum rises")
    n = t["features"].count()
    shape = t["modes"].agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.isnan("regression") & F.col("regression").isNotNull()).alias("ok")).first()
    require(shape["n"] == shape["ok"] == n * k, "the modes' shape")
    per = t["pc"].groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("t").alias("d")).collect()
    require(len(per) == k and len({r["n"] for r in per}) == 1 and all(r["n"] == r["d"] for r in per), "the coefficients' shape")
    return t


def mode_cells(t: dict[str, DataFrame]) -> DataFrame:
    """(mode, [level,] row, col, u, v, eta, area, lon, lat): regression patterns on the cells that take part."""
    keys = ["row", "col", *(["level"] if "level" in t["features"].columns else [])]
    wide = t["modes"].join(t["features"].select("feature_id", "component", *keys), "feature_id").groupBy("mode", *keys).pivot("component", ["u", "v", "eta"]).agg(F.first("regression"))
    return wide.join(t["cells"].select("row", "col", "lon", "lat", "area"), ["row", "col"])


def _box(spark: SparkSession, run: str, e) -> tuple[float, float, float, float]:
    """The analysis box of a run's configuration."""
    raw = json.loads(runs.read_text(spark, f"{run}/config.json"))
    own = raw.get("focus", raw.get("domain", {})).get("bbox_lon_lat")
    return tuple(own) if own else (e["min_lon"], e["max_lon"], e["min_lat"], e["max_lat"])


def figure_tables(spark: SparkSession, run: str, mode_from: int = 1, mode_to: int = 5, most_arrows: int = 16, step_hours: float = 1.0) -> dict[str, DataFrame]:
    """The tables behind the figures: limits, arrows, coefficients with daily means and segments, scree, coverage."""
    t = validated(spark, run)
    pick = F.col("mode").between(mode_from, mode_to)
    cells = mode_cells(t).where(pick)
    e = t["cells"].agg(*(f(c).alias(f"{n}_{c}") for c in ("lon", "lat", "row", "col") for n, f in (("min", F.min), ("max", F.max)))).first()
    rows, cols = (e[f"max_{c}"] - e[f"min_{c}"] + 1 for c in ("row", "col"))
    steps = ((e["max_lon"] - e["min_lon"]) / max(1, cols - 1), (e["max_lat"] - e["min_lat"]) / max(1, rows - 1))
    extent = masks.map_extent(cells, _box(spark, run, e), *steps)
    by = ("mode", "level") if "level" in cells.columns else ("mode",)
    step = stats.quiver_step(rows, cols, most_arrows)
    pcs = t["pc"].where(pick)
    coverage = t["features"].groupBy(*(["component", "level"] if "level" in t["features"].columns else ["component"])).agg(F.count(F.lit(1)).alias("cells"))
    return {
        "limits": stats.map_limits(cells, max(float(e["max_lon"] - e["min_lon"]), 1e-9), *by),
        "arrows": masks.thinned(cells, step, extent),
        "coefficients": timeaxis.segments(pcs, step_hours, "t", 1.5, "mode"),
        "daily": stats.daily_means(pcs, "standardised"),
        "scree": stats.scree(t["spectrum"]),
        "coverage": coverage,
    }


def replot(spark: SparkSession, run: str, config: dict[str, Any], output_root: str, bundle: str, **options: Any) -> str:
    """A bundle of figure tables from a run of the same science; the run stays as it is."""
    before = runs.same_science(spark, run, config)
    tables = figure_tables(spark, run, **options)

    def write(folder: str) -> None:
        runs.write_tables(folder, tables)
        require(runs.same_science(spark, run, config) == before, "the run changed meanwhile")
        runs.write_json(spark, f"{folder}/metadata.json", {"source_run": run.rstrip("/").rsplit("/", 1)[-1], "science": before, "options": options})

    return runs.publish(spark, f"{output_root}/figure_bundles/{run.rstrip('/').rsplit('/', 1)[-1]}/{bundle}", write)


def replot_batch(spark: SparkSession, jobs: list[tuple[str, dict[str, Any]]], output_root: str, bundle: str, concurrent: int = 2) -> list[str]:
    require(len({r for r, _ in jobs}) == len(jobs), "a run is listed twice")
    return together([lambda r=r, c=c: replot(spark, r, c, output_root, bundle) for r, c in jobs], concurrent)


def feature_index(t: dict[str, DataFrame]) -> DataFrame:
    """The public index of a host matrix: a row per feature, numbered from 0 and from 1."""
    name = F.element_at(F.array(*map(F.lit, LEVEL_IDS)), F.col("level") + 1)
    depth = F.element_at(F.array(*map(F.lit, LEVEL_DEPTHS)), F.col("level") + 1)
    rows = t["features"].join(t["cells"].select("row", "col", "lon", "lat"), ["row", "col"])
    return rows.select(
        F.col("feature_id").alias("host_feature_index_zero_based"), (F.col("feature_id") + 1).alias("host_feature_index_one_based"), F.lit("row_of_A_feature_by_time").alias("matrix_axis"), "component",
        F.when(F.col("level") < 0, "eta_surface").otherwise(name).alias("velocity_level_id"), F.when(F.col("level") < 0, 0.0).otherwise(depth).alias("depth_m_below_surface"),
        F.col("row").alias("grid_row_zero_based"), F.col("col").alias("grid_col_zero_based"), (F.col("row") + 1).alias("grid_row_one_based"), (F.col("col") + 1).alias("grid_col_one_based"),
        F.col("lon").alias("longitude_degrees_east"), F.col("lat").alias("latitude_degrees_north"), F.col("mean").alias("physical_mean"), F.col("scale").alias("feature_scale"),
    )


def host_layout(spark: SparkSession, run: str, output_root: str) -> str:
    """Factors of the (feature, time) matrix in the order eta, u, v: a permutation of what was solved, checked by going back."""
    t = validated(spark, run)
    ordered = features.feature_map(t["features"].drop("feature_id").withColumn("old", F.lit(None)), features.COLUMN_ORDER).drop("old")
    keys = [c for c in ("component", "level", "row", "col") if c in t["features"].columns]
    moved = t["features"].select("feature_id", *keys).join(ordered.select(F.col("feature_id").alias("host"), *keys), keys)
    renamed = lambda df: df.join(moved.select("feature_id", "host"), "feature_id").drop("feature_id").withColumnRenamed("host", "feature_id")
    own = {**t, "features": renamed(t["features"]), "modes": renamed(t["modes"])}
    left, right = modes.host_layout(own["modes"], own["pc"], own["spectrum"])
    difference = modes.round_trip(own["modes"].select("mode", "feature_id", "physical"), left, own["features"]).first()[0]
    back = right.join(F.broadcast(own["spectrum"]), "mode").join(own["pc"].select("mode", "t", F.col("value").alias("was")), ["mode", "t"]).agg(F.max(F.abs(F.col("value") * F.col("sigma") - F.col("was")))).first()[0]
    departure = modes.orthogonality(left).first()[0]
    require(difference <= 1e-12 and departure <= 1e-9, f"the way back differs by {difference:.3g}, orthogonality by {departure:.3g}")

    def write(folder: str) -> None:
        runs.write_tables(folder, {"left": left, "right": right, "spectrum": own["spectrum"], "features": own["features"]})
        if "level" in keys:
            feature_index(own).orderBy("host_feature_index_zero_based").coalesce(1).write.csv(f"{folder}/feature_index_map", header=True)
        runs.write_json(spark, f"{folder}/metadata.json", {"source_run": run.rstrip("/").rsplit("/", 1)[-1], "max_difference": difference, "max_pc_difference": back, "orthogonality": departure})

    return runs.publish(spark, f"{output_root}/host_layout/{run.rstrip('/').rsplit('/', 1)[-1]}", write)


def read_feature_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lon by column, lat by row) rebuilt from an index; raises if cells of one row or column disagree."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    axes = []
    for place, value in (("grid_col_zero_based", "longitude_degrees_east"), ("grid_row_zero_based", "latitude_degrees_north")):
        a = rows.groupBy(F.col(place).cast("long").alias("place")).agg(F.min(F.col(value).cast("double")).alias("value"), F.max(F.col(value).cast("double")).alias("high"))
        require(a.where("high - value > 1e-9").isEmpty(), f"{value} differs within {place}")
        axes.append(a.drop("high"))
    return axes[0], axes[1]


def reconstruction(spark: SparkSession, run: str, rank: int, times: list[int] | None = None) -> DataFrame:
    """(component, [level,] row, col, t, value): mean plus the first ``rank`` modes, at the given times or all."""
    t = validated(spark, run)
    chosen = spark.createDataFrame([(x,) for x in times], "t long") if times is not None else None
    if chosen is not None:
        require(chosen.join(t["pc"].select("t").distinct(), "t", "left_anti").isEmpty(), "a time is not in the run")
    out = modes.reconstruct(t["features"], t["modes"].select("mode", "feature_id", "physical"), t["pc"], rank, chosen)
    return out.join(t["features"].drop("mean", "scale"), "feature_id").drop("feature_id")


def region_report(spark: SparkSession, region_runs: dict[str, str], theoretical_times: int = 17_544) -> DataFrame:
    """A row per region and mode: explained variance and its class, flow statistics, area, coverage."""
    out = None
    for name, run in region_runs.items():
        t = validated(spark, run)
        cells = mode_cells(t)
        n = t["pc"].agg(F.countDistinct("t")).first()[0]
        two = t["spectrum"].where("mode <= 2").agg((100 * F.sum("ev")).alias("two"))
        own = stats.mode_stats(cells).join(t["spectrum"], "mode").crossJoin(F.broadcast(two.select(ev_class(F.col("two")).alias("kind"))))
        own = own.crossJoin(F.broadcast(stats.area_stats(cells.where("mode = 1")).select("area_km2", "cells"))).withColumn("region", F.lit(name)).withColumn("coverage", F.lit(stats.coverage(n, theoretical_times)))
        out = own if out is None else out.unionByName(own)
    return out


def together(jobs: list[Callable[[], str]], concurrent: int) -> list[str]:
    """Results in the order of the jobs. The first failure cancels what has not begun and is raised; what was published stays."""
    with ThreadPoolExecutor(max_workers=max(1, concurrent)) as pool:
        futures = [pool.submit(j) for j in jobs]
        done, _ = wait(futures, return_when=FIRST_EXCEPTION)
        failed = next((f for f in done if not f.cancelled() and f.exception()), None)
        if failed:
            for f in futures:
                f.cancel()
            raise failed.exception()
        return [f.result() for f in futures]


def run_batch(spark: SparkSession, batch: BatchConfig, surface_root: str, output_root: str, *, skip_existing: bool = False, **allow: bool) -> list[str]:
    """All regions of a batch, several at a time on one cluster; Spark shares it among their jobs."""
    from . import surface

    def one(path) -> str:
        config = surface_config(path)
        if skip_existing:
            from ..sources import arrays

            found = arrays.months(surface_root, config.domain, config.input.month_ids, required=config.input.required_kinds, schema_major=config.input.schema_major, **allow)
            final = f"{output_root}/svd/{runs.run_id(config.label, config.raw, [(m.month, m.digest) for m in found])}"
            if runs.exists(spark, f"{final}/metadata.json"):
                return final
        return surface.run(spark, config, surface_root, output_root, **allow)

    return together([lambda p=p: one(p) for p in batch.configs], batch.max_concurrent)
