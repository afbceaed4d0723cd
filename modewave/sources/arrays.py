"""Array caches on a shared file system: a folder of ``.npy`` files per domain and month, read by the executors.

    <root>/<domain>/grid/{lon,lat,cell_area_m2,mask_static,...}.npy, metadata.json
    <root>/<domain>/months/<YYYYMM>/{time_utc_ns,u_surface_mps,v_surface_mps,eta_m,valid_mask_surface}.npy, metadata.json

A task maps a few time steps of a month and copies its window only. What comes out is a long table; missing
values of any kind are null. ``to_parquet`` writes it once, partitioned by month, for runs that come back.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import require
from ..functions.scalar import finite_or_null, sha256_json
from ..operators.masks import eligible
from . import runs

TIMES_PER_TASK = 48


def load(path: Path) -> np.ndarray:
    require(path.is_file(), f"{path} is absent")
    return np.load(path, mmap_mode="r", allow_pickle=False)


@dataclass(frozen=True)
class Month:
    month: str
    kind: str
    n_times: int
    metadata: dict[str, Any]

    @property
    def digest(self) -> str:
        return sha256_json(self.metadata)


def months(root: str, domain: str, ids: list[str], *, allow_partial: bool = False, allow_trial: bool = False, required: frozenset[str] = frozenset({"standard_month"}), schema_major: int = 3) -> list[Month]:
    """Metadata and lengths of the months, in the order asked for; nothing but headers is read."""
    out = []
    for month in ids:
        folder = Path(root) / domain / "months" / month
        meta_path = folder / "metadata.json"
        require(meta_path.is_file(), f"{month}: no metadata")
        meta = json.loads(meta_path.read_text(encoding="utf-8"))
        kind = _allowed(month, domain, meta, allow_partial, allow_trial, required, schema_major)
        time = load(folder / "time_utc_ns.npy")
        require(time.dtype == np.int64 and time.ndim == 1 and len(time) > 0, f"{month}: time axis")
        out.append(Month(month, kind, len(time), meta))
    return out


def _allowed(month: str, domain: str, meta: dict[str, Any], allow_partial: bool, allow_trial: bool, required: frozenset[str], schema_major: int) -> str:
    """The kind of a month that may be read; raises for others."""
    require(str(meta.get("cache_schema_version", schema_major)).split(".")[0] == str(schema_major), f"{month}: schema version")
    named = meta.get("domain", {})
    require((named.get("domain_id") if isinstance(named, dict) else named) in (None, domain), f"{month}: another domain")
    require(str(meta.get("month", month)).replace("-", "") == month, f"{month}: metadata of another month")
    status, kind = meta.get("status"), meta.get("cache_kind")
    require(eligible(status, kind, allow_partial=allow_partial, allow_trial=allow_trial, required=required), f"{month}: {status}, {kind}")
    return kind


def grid(spark: SparkSession, root: str, domain: str) -> DataFrame:
    """(row, col, lon, lat, area, static, bathymetry): one row per cell of the regular grid."""
    folder = Path(root) / domain / "grid"
    lon, lat = np.asarray(load(folder / "lon.npy"), float), np.asarray(load(folder / "lat.npy"), float)
    for name, axis in (("lon", lon), ("lat", lat)):
        require(axis.ndim == 1 and bool((np.diff(axis) > 0).all()), f"{name} does not rise")
    area, static = np.asarray(load(folder / "cell_area_m2.npy"), float), np.asarray(load(folder / "mask_static.npy"), bool)
    require(area.shape == static.shape == (len(lat), len(lon)), "the grid's arrays don't fit its axes")
    deep = folder / "bathymetry_m.npy"
    depth = np.asarray(load(deep), float) if deep.is_file() else np.full(area.shape, np.nan)
    row, col = np.indices(area.shape)
    pdf = pd.DataFrame({"row": row.ravel(), "col": col.ravel(), "lon": lon[col.ravel()], "lat": lat[row.ravel()], "area": area.ravel(), "static": static.ravel(), "bathymetry": depth.ravel()})
    return spark.createDataFrame(pdf, "row long, col long, lon double, lat double, area double, static boolean, bathymetry double").withColumn("bathymetry", finite_or_null("bathymetry"))


def mesh(spark: SparkSession, root: str, domain: str) -> DataFrame:
    """(row, col, slot, node, weight): three vertices per cell; -1 stands for none."""
    folder = Path(root) / domain / "grid"
    v, w = np.asarray(load(folder / "source_vertices.npy")), np.asarray(load(folder / "source_weights.npy"), float)
    require(v.shape == w.shape and v.ndim == 3 and v.shape[2] == 3, "vertices and weights")
    row, col, slot = np.indices(v.shape)
    pdf = pd.DataFrame({"row": row.ravel(), "col": col.ravel(), "slot": slot.ravel(), "node": v.ravel(), "weight": w.ravel()})
    return spark.createDataFrame(pdf, "row long, col long, slot int, node long, weight double").withColumn("weight", finite_or_null("weight"))


def _pieces(spark: SparkSession, found: list[Month], per_task: int) -> DataFrame:
    rows = [(m.month, order, a, min(a + per_task, m.n_times)) for order, m in enumerate(found) for a in range(0, m.n_times, per_task)]
    return spark.createDataFrame(rows, "month string, ordinal int, a long, b long").repartition(max(1, min(len(rows), 10_000)))


def axis(spark: SparkSession, root: str, domain: str, found: list[Month]) -> DataFrame:
    """(month, ordinal, src, t): the source order of all time steps, from the time files alone."""

    def run(frames):
        for f in frames:
            for p in f.itertuples():
                t = load(Path(root) / domain / "months" / p.month / "time_utc_ns.npy")[p.a : p.b]
                yield pd.DataFrame({"month": p.month, "ordinal": p.ordinal, "src": np.arange(p.a, p.b), "t": np.asarray(t)})

    return _pieces(spark, found, 100_000).mapInPandas(run, "month string, ordinal int, src long, t long")


def surface(spark: SparkSession, root: str, domain: str, found: list[Month], window: tuple[int, int, int, int] | None = None, per_task: int = TIMES_PER_TASK) -> DataFrame:
    """(month, ordinal, src, row, col, u, v, eta, valid) of a window (first row, end row, first col, end col)."""

    def run(frames):
        for f in frames:
            for p in f.itertuples():
                folder = Path(root) / domain / "months" / p.month
                fields = {c: load(folder / f"{n}.npy") for c, n in (("u", "u_surface_mps"), ("v", "v_surface_mps"), ("eta", "eta_m"), ("valid", "valid_mask_surface"))}
                shape = fields["u"].shape
                if any(x.shape != shape for x in fields.values()):
                    raise ValueError(f"{p.month}: fields differ in shape")
                r0, r1, c0, c1 = window or (0, shape[1], 0, shape[2])
                src, row, col = np.meshgrid(np.arange(p.a, p.b), np.arange(r0, r1), np.arange(c0, c1), indexing="ij")
                cut = {c: np.asarray(x[p.a : p.b, r0:r1, c0:c1]).ravel() for c, x in fields.items()}
                yield pd.DataFrame({"month": p.month, "ordinal": p.ordinal, "src": src.ravel(), "row": row.ravel(), "col": col.ravel(), **{c: cut[c].astype(float) for c in ("u", "v", "eta")}, "valid": cut["valid"].astype(bool)})

    raw = _pieces(spark, found, per_task).mapInPandas(run, "month string, ordinal int, src long, row long, col long, u double, v double, eta double, valid boolean")
    return raw.withColumns({c: finite_or_null(c) for c in ("u", "v", "eta")})


def native(spark: SparkSession, root: str, domain: str, found: list[Month], nodes: list[int], per_task: int = TIMES_PER_TASK) -> DataFrame:
    """(month, ordinal, src, node, layer, z, u, v) of the nodes that some cell needs; others are not read."""
    wanted = spark.sparkContext.broadcast(np.array(sorted(nodes)))
    index = Path(root) / domain / "grid" / "source_node_global_index.npy"
    if index.is_file():
        require(len(load(index)) > max(nodes, default=-1), "nodes beyond the native grid")

    def run(frames):
        for f in frames:
            for p in f.itertuples():
                folder = Path(root) / domain / "months" / p.month
                vel, z = load(folder / "hvel.npy"), load(folder / "zcor.npy")
                if vel.shape[:3] != z.shape:
                    raise ValueError(f"{p.month}: hvel and zcor differ in shape")
                own = wanted.value
                v, h = np.asarray(vel[p.a : p.b, own, :, :2], float), np.asarray(z[p.a : p.b, own], float)
                src, at, layer = np.meshgrid(np.arange(p.a, p.b), own, np.arange(h.shape[2]), indexing="ij")
                yield pd.DataFrame({"month": p.month, "ordinal": p.ordinal, "src": src.ravel(), "node": at.ravel(), "layer": layer.ravel(), "z": h.ravel(), "u": v[..., 0].ravel(), "v": v[..., 1].ravel()})

    raw = _pieces(spark, found, per_task).mapInPandas(run, "month string, ordinal int, src long, node long, layer int, z double, u double, v double")
    return raw.withColumns({c: finite_or_null(c) for c in ("z", "u", "v")})


def to_parquet(df: DataFrame, path: str, times: int = 240) -> None:
    """Writes a long cube once, a folder per month and files of ``times`` steps: later runs prune months and columns at the scan."""
    df.repartition("month", F.floor(F.col("src") / times)).sortWithinPartitions("src").write.partitionBy("month").mode("errorifexists").parquet(path)


def export(spark: SparkSession, root: str, domain: str, found: list[Month], out: str) -> str:
    """A domain's grid, axis, surface cube and months as tables under ``out``, for runs that read from any store."""
    folder = f"{out}/{domain}"
    grid(spark, root, domain).write.mode("errorifexists").parquet(f"{folder}/grid")
    axis(spark, root, domain, found).write.mode("errorifexists").parquet(f"{folder}/axis")
    to_parquet(surface(spark, root, domain, found), f"{folder}/cube")
    runs.write_json(spark, f"{folder}/months.json", {m.month: {"n_times": m.n_times, "metadata": m.metadata} for m in found})
    return folder


def exported_months(spark: SparkSession, root: str, domain: str, ids: list[str], *, allow_partial: bool = False, allow_trial: bool = False, required: frozenset[str] = frozenset({"standard_month"}), schema_major: int = 3) -> list[Month]:
    """As ``months``, of an exported domain."""
    have, out = json.loads(runs.read_text(spark, f"{root}/{domain}/months.json")), []
    for month in ids:
        require(month in have, f"{month}: not exported")
        meta = have[month]["metadata"]
        out.append(Month(month, _allowed(month, domain, meta, allow_partial, allow_trial, required, schema_major), have[month]["n_times"], meta))
    return out


def exported(spark: SparkSession, root: str, domain: str, found: list[Month], window: tuple[int, int, int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(cube, axis) of the months, numbered as they are asked for."""
    order = spark.createDataFrame([(m.month, i) for i, m in enumerate(found)], "month string, ordinal int")
    ids = [m.month for m in found]
    numbered = lambda df: df.drop("ordinal").join(F.broadcast(order), "month")  # noqa: E731  one row per month
    return numbered(from_parquet(spark, f"{root}/{domain}/cube", ids, window)), numbered(from_parquet(spark, f"{root}/{domain}/axis", ids))


def from_parquet(spark: SparkSession, path: str, month_ids: list[str], window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """The long cube's months and window; both reach the scan, on any store that Spark reads."""
    df = spark.read.parquet(path)
    df = df.withColumn("month", F.col("month").cast("string")).where(F.col("month").isin(month_ids))
    if window:
        df = df.where(F.col("row").between(window[0], window[1] - 1) & F.col("col").between(window[2], window[3] - 1))
    return df
