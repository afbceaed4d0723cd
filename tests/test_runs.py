"""Whole runs on small array caches."""

import copy
import json

import numpy as np
import pytest

from modewave.cli import parser
from modewave.errors import ContractError
from modewave.plans import column, products, surface
from modewave.sources import arrays, runs
from modewave.sources.config import batch_config, column_config, surface_config

H = 3_600_000_000_000
START = 1_735_689_600_000_000_000  # 2025-01-01


def surface_cache(root, shift_second=0, n=5, steps=24):
    folder = root / "demo"
    grid = folder / "grid"
    grid.mkdir(parents=True)
    np.save(grid / "lon.npy", 120 + 0.01 * np.arange(n))
    np.save(grid / "lat.npy", 22 + 0.01 * np.arange(n))
    np.save(grid / "cell_area_m2.npy", np.full((n, n), 1e6))
    np.save(grid / "mask_static.npy", np.ones((n, n), bool))
    rng = np.random.default_rng(3)
    for i, month in enumerate(("202501", "202502")):
        m = folder / "months" / month
        m.mkdir(parents=True)
        np.save(m / "time_utc_ns.npy", START + H * (np.arange(steps) + steps * i) + (shift_second if i else 0))
        for name, mean in (("u_surface_mps", 0.2), ("v_surface_mps", -0.1), ("eta_m", 0.05)):
            x = (mean + rng.normal(size=(steps, n, n))).astype(np.float32)
            if name == "u_surface_mps" and i == 0:
                x[7, 2, 2] = np.nan
            np.save(m / f"{name}.npy", x)
        np.save(m / "valid_mask_surface.npy", np.ones((steps, n, n), bool))
        (m / "metadata.json").write_text(json.dumps({"status": "ready", "cache_kind": "standard_month", "month": month, "cache_schema_version": "3.0.0", "domain": {"domain_id": "demo"}}))
    return root


SURFACE = {
    "schema_version": "1.0.0", "analysis_kind": "surface_multivariate_svd", "analysis_label": "demo v1",
    "focus": {"focus_id": "f", "name_zh": "x", "approval_status": "candidate", "flow_domain_id": "demo", "bbox_lon_lat": [120.01, 120.03, 22.01, 22.03], "anchor_lonlat": [120.02, 22.02], "spatial_mask_policy": "analysis_bbox_cell_center", "analysis_unit_id": "unit"},
    "input": {"years": [2025], "months": [1, 2], "required_cache_schema_major": 3, "expected_timestep_hours": 1.0, "maximum_source_gap_hours": None, "time_axis_canonicalization_policy": "sort_and_deduplicate_prefer_last"},
    "mask_and_missing_data": {"minimum_static_ocean_cells": 9, "minimum_cell_triplet_valid_fraction": 0.95, "max_consecutive_missing_timesteps_to_interpolate": 2, "minimum_retained_time_fraction": 0.9},
    "svd": {"requested_mode_count": 5, "minimum_reported_mode_count": 5}, "figures": {"mode_count": 5},
}


def plain(root):
    """The surface modes by numpy, from the files."""
    f = root / "demo" / "months"
    x = np.stack([np.concatenate([np.load(f / m / f"{n}.npy") for m in ("202501", "202502")])[:, 1:4, 1:4].astype(float).reshape(48, 9) for n in ("u_surface_mps", "v_surface_mps", "eta_m")], axis=1)
    x[7, :, 4] = (x[6, :, 4] + x[8, :, 4]) / 2
    a = x - x.mean(axis=0)
    vel, eta = np.sqrt((a[:, :2] ** 2).sum() / (2 * 48 * 9)), np.sqrt((a[:, 2] ** 2).sum() / (48 * 9))
    return np.linalg.svd(np.concatenate([a[:, 0] / vel, a[:, 1] / vel, a[:, 2] / eta], axis=1) * 1e3, compute_uv=False), vel, eta


def test_surface_run(spark, tmp_path):
    root = surface_cache(tmp_path / "cache")
    out = surface.run(spark, surface_config(SURFACE), str(root), str(tmp_path / "out"))
    meta = runs.read_metadata(spark, out)
    assert meta["status"] == "candidate_pilot" and meta["preparation"]["common_ocean_cell_count"] == 9
    assert meta["imputed_scalar_count"] == 3 and meta["preparation"]["retained_time_count"] == 48
    assert abs(meta["sum_ev"] - 1) < 1e-10 and meta["orthogonality"] < 1e-10
    s, vel, eta = plain(root)
    t = products.validated(spark, out)
    assert np.allclose([r["sigma"] for r in t["spectrum"].orderBy("mode").collect()], s[:5], rtol=1e-9)
    assert meta["velocity_rms"] == pytest.approx(vel) and meta["eta_rms"] == pytest.approx(eta)
    # regression times standardised coefficient is mode times coefficient
    x = t["modes"].join(t["pc"], "mode").selectExpr("max(abs(regression * standardised - physical * value)) as d").first()[0]
    assert x < 1e-12
    with pytest.raises(ContractError):
        surface.run(spark, surface_config(SURFACE), str(root), str(tmp_path / "out"))
    # products of the run
    other = copy.deepcopy(SURFACE)
    other["figures"]["mode_count"] = 3
    bundle = products.replot(spark, out, other, str(tmp_path / "out"), "v1")
    assert spark.read.parquet(f"{bundle}/scree").count() == 5 and spark.read.parquet(f"{bundle}/daily").count() == 10
    other["svd"]["requested_mode_count"] = 6
    with pytest.raises(ContractError):
        products.replot(spark, out, other, str(tmp_path / "out"), "v2")
    full = products.reconstruction(spark, out, 5, [START])
    assert full.count() == 27
    report = products.region_report(spark, {"demo": out})
    assert report.count() == 5 and report.where("directional_coherence between 0 and 1").count() == 5
    assert runs.selection(spark, str(tmp_path / "out" / "svd"), SURFACE) == ("exact", str(tmp_path / "out" / "svd" / out.rsplit("/", 1)[1]))


def test_tasks_of_a_run_follow_its_rows_not_the_shuffle_partitions(spark, tmp_path):
    """What a run keeps, and its matrix, lie in as many partitions as their rows need."""
    surface_cache(tmp_path / "ocm_surface")
    config, root = surface_config(SURFACE), str(tmp_path / "ocm_surface")
    found = arrays.months(root, config.domain, config.input.month_ids)
    grid = arrays.grid(spark, root, config.domain)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        p = surface.prepare(arrays.surface(spark, root, config.domain, found), arrays.axis(spark, root, config.domain, found), grid, config)
        s = surface.solve(p, config)
        assert p.state.count() == len(p.axis) * p.report["common_ocean_cell_count"]
        assert [df.rdd.getNumPartitions() for df in (p.state, s.features, s.matrix.blocks)] == [1, 1, 1]
        assert surface.packed(spark.range(0, 1000, 1, 50), 250_001).rdd.getNumPartitions() == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_overlapping_months_prefer_the_last(spark, tmp_path):
    root = surface_cache(tmp_path / "cache", shift_second=-24 * H)
    seen = surface.preflight(spark, surface_config(SURFACE), str(root))
    assert seen["times"] == 24 and seen["dropped"] == 24
    raw = copy.deepcopy(SURFACE)
    raw["input"]["known_time_axis_repairs"] = [{"month": "202502", "start_index": 0, "stop_index": 24, "shift_hours": 24.0, "expected_original_start_utc": "2025-01-01T00:00:00Z", "expected_original_end_utc": "2025-01-01T23:00:00Z"}]
    assert surface.preflight(spark, surface_config(raw), str(root))["times"] == 48
    raw["input"]["time_axis_canonicalization_policy"] = "reject"
    raw["input"]["known_time_axis_repairs"] = []
    with pytest.raises(ContractError):
        surface.preflight(spark, surface_config(raw), str(root))


def batch_files(folder, change=lambda batch, regions: None):
    """A batch of two regions, as it is published; ``change`` spoils it."""
    regions = []
    for i in (1, 2):
        raw = copy.deepcopy(SURFACE)
        raw["analysis_label"] = f"demo{i}"
        raw["focus"] |= {"analysis_unit_id": f"unit{i}", "source_analysis_units_config": "units.json", "source_analysis_units_config_sha256": "ab" * 32}
        raw["parallel_execution"] = {"io_workers": 3, "linear_algebra_threads": 4}
        regions.append(raw)
    batch = {
        "schema_version": "1.0.0", "analysis_kind": "surface_multivariate_svd_batch", "batch_label": "b", "source_analysis_units_config": "units.json", "source_analysis_units_config_sha256": "ab" * 32,
        "parallel_execution": {"server_minimum_cpu_cores": 8, "max_concurrent_regions": 2, "per_region_linear_algebra_threads": 4, "per_region_io_workers": 3},
        "region_configs": [{"analysis_unit_id": f"unit{i}", "config": f"c{i}.json"} for i in (1, 2)],
    }
    change(batch, regions)
    for i, raw in enumerate(regions):
        (folder / f"c{i + 1}.json").write_text(json.dumps(raw))
    (folder / "batch.json").write_text(json.dumps(batch))


@pytest.mark.parametrize(
    "change",
    [
        lambda b, r: b.update(schema_version="2.0.0"),
        lambda b, r: b.update(analysis_kind="surface_multivariate_svd"),
        lambda b, r: b.update(batch_label=" "),
        lambda b, r: b.pop("source_analysis_units_config"),
        lambda b, r: b.update(source_analysis_units_config_sha256="AB" * 32),
        lambda b, r: b.update(source_analysis_units_config_sha256="cd" * 32),
        lambda b, r: b.update(source_analysis_units_config="other.json"),
        lambda b, r: b.update(parallel_execution=[]),
        lambda b, r: b["parallel_execution"].pop("server_minimum_cpu_cores"),
        lambda b, r: b["parallel_execution"].update(server_minimum_cpu_cores=7),
        lambda b, r: b["parallel_execution"].update(max_concurrent_regions=True),
        lambda b, r: b["parallel_execution"].update(max_concurrent_regions=1),
        lambda b, r: b["parallel_execution"].update(per_region_io_workers=4),
        lambda b, r: b.update(region_configs=[]),
        lambda b, r: b.update(region_configs=["c1.json"]),
        lambda b, r: b["region_configs"][1].update(analysis_unit_id="unit1"),
        lambda b, r: b["region_configs"][1].update(config="c1.json"),
        lambda b, r: b["region_configs"][1].update(config="./c1.json", analysis_unit_id="unit3"),
        lambda b, r: r[1]["focus"].update(analysis_unit_id="unit9"),
        lambda b, r: r[1]["focus"].update(source_analysis_units_config_sha256="cd" * 32),
        lambda b, r: r[1]["parallel_execution"].update(linear_algebra_threads=2),
        lambda b, r: r[1].pop("parallel_execution"),
    ],
)
def test_batch_rules(tmp_path, change):
    batch_files(tmp_path)
    batch_config(tmp_path / "batch.json")
    batch_files(tmp_path, change)
    with pytest.raises(ContractError):
        batch_config(tmp_path / "batch.json")


def test_years_and_the_older_year():
    def years(**own):
        raw = copy.deepcopy(SURFACE)
        raw["input"].pop("years")
        raw["input"] |= own
        return surface_config(raw).input.years

    assert years(year=2025) == (2025,) and years(years=[2024, 2025]) == (2024, 2025) and years(years=[2024, 2025], year=2025) == (2024, 2025)
    for bad in ({}, {"years": [2025, 2024]}, {"years": [2025, 2025]}, {"years": [2024, 2025], "year": 2024}, {"year": True}, {"years": []}):
        with pytest.raises(ContractError):
            years(**bad)


def test_surface_run_from_tables(spark, tmp_path):
    """A run from exported tables equals one from arrays; months and window reach the scan."""
    root = surface_cache(tmp_path / "cache")
    found = arrays.months(str(root), "demo", ["202501", "202502"])
    arrays.export(spark, str(root), "demo", found, str(tmp_path / "tables"))
    a = surface.run(spark, surface_config(SURFACE), str(root), str(tmp_path / "a"))
    b = surface.run(spark, surface_config(SURFACE), str(tmp_path / "tables"), str(tmp_path / "b"), parquet=True)
    assert a.rsplit("/", 1)[1] == b.rsplit("/", 1)[1]
    one, two = ([r["sigma"] for r in spark.read.parquet(f"{x}/spectrum").orderBy("mode").collect()] for x in (a, b))
    assert np.allclose(one, two, rtol=1e-12)
    cube, axis = arrays.exported(spark, str(tmp_path / "tables"), "demo", found[1:], (1, 4, 1, 4))
    assert cube.count() == 24 * 9 and axis.count() == 24 and {r[0] for r in axis.select("ordinal").distinct().collect()} == {0}
    plan = cube._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan" in line)
    assert "202502" in scan.split("PartitionFilters")[1] and "GreaterThanOrEqual(row,1)" in scan
    with pytest.raises(ContractError):
        arrays.exported_months(spark, str(tmp_path / "tables"), "demo", ["202503"])


def test_selection_of_runs(spark, tmp_path):
    def publish(name, config):
        (tmp_path / "svd" / name).mkdir(parents=True)
        for f, v in (("config", config), ("metadata", {})):
            (tmp_path / "svd" / name / f"{f}.json").write_text(json.dumps(v))

    root, old = str(tmp_path / "svd"), copy.deepcopy(SURFACE)
    old["svd"]["requested_mode_count"] = 7
    assert runs.selection(spark, root, SURFACE) == ("pending", None)
    publish("demo_v1_0", old)
    assert runs.selection(spark, root, SURFACE) == ("legacy", f"{root}/demo_v1_0")
    assert runs.selection(spark, root, SURFACE, allow_legacy=False) == ("stale", None)
    publish("demo_v1_1", {**old, "analysis_label": "x"})
    with pytest.raises(ContractError):
        runs.selection(spark, root, SURFACE)
    publish("demo_v1_2", {**SURFACE, "figures": {"mode_count": 9}})
    assert runs.selection(spark, root, SURFACE) == ("exact", f"{root}/demo_v1_2")
    publish("demo_v1_3", SURFACE)
    with pytest.raises(ContractError):
        runs.selection(spark, root, SURFACE)


def test_batch_and_parquet(spark, tmp_path):
    root = surface_cache(tmp_path / "cache")
    batch_files(tmp_path)
    b = batch_config(tmp_path / "batch.json")
    assert (b.max_concurrent, b.threads, b.io_workers, b.least_cores, b.units) == (2, 4, 3, 8, ("unit1", "unit2"))
    out = products.run_batch(spark, b, str(root), str(tmp_path / "out"))
    assert [("demo1" in out[0]), ("demo2" in out[1])] == [True, True]
    assert products.run_batch(spark, b, str(root), str(tmp_path / "out"), skip_existing=True) == out
    found = arrays.months(str(root), "demo", ["202501", "202502"])
    arrays.to_parquet(arrays.surface(spark, str(root), "demo", found), str(tmp_path / "cube"))
    one = arrays.from_parquet(spark, str(tmp_path / "cube"), ["202502"], (1, 3, 1, 3))
    assert one.count() == 24 * 4
    assert "PushedFilters" in one._jdf.queryExecution().toString() and one.select("u")._jdf.queryExecution().executedPlan().toString().count("eta") == 0


def column_caches(tmp):
    surf, nat = tmp / "surface", tmp / "native"
    n, steps = 4, 24
    rng = np.random.default_rng(20)
    for root in (surf, nat):
        (root / "demo" / "grid").mkdir(parents=True)
    g = surf / "demo" / "grid"
    np.save(g / "lon.npy", np.linspace(120, 120.03, n))
    np.save(g / "lat.npy", np.linspace(22, 22.03, n))
    np.save(g / "cell_area_m2.npy", np.full((n, n), 1e6))
    np.save(g / "bathymetry_m.npy", np.full((n, n), 70.0))
    np.save(g / "mask_static.npy", np.ones((n, n), bool))
    node = np.arange(n * n).reshape(n, n)
    np.save(g / "source_vertices.npy", np.stack([node] * 3, axis=2))
    np.save(g / "source_weights.npy", np.stack([np.ones((n, n)), np.zeros((n, n)), np.zeros((n, n))], axis=2))
    np.save(nat / "demo" / "grid" / "source_node_global_index.npy", np.arange(n * n))
    z = np.arange(-60.0, 1, 10)
    for i, month in enumerate(("202501", "202502")):
        meta = json.dumps({"status": "ready", "cache_kind": "standard_month", "month": month, "config_hash": "h", "domain": {"domain_id": "demo"}})
        for root in (surf, nat):
            m = root / "demo" / "months" / month
            m.mkdir(parents=True)
            np.save(m / "time_utc_ns.npy", START + H * (np.arange(steps) + steps * i))
            (m / "metadata.json").write_text(meta)
        m = surf / "demo" / "months" / month
        for name, sd in (("u_surface_mps", 0.4), ("v_surface_mps", 0.35), ("eta_m", 0.12)):
            np.save(m / f"{name}.npy", rng.normal(0, sd, (steps, n, n)).astype(np.float32))
        np.save(m / "valid_mask_surface.npy", np.ones((steps, n, n), bool))
        m = nat / "demo" / "months" / month
        np.save(m / "hvel.npy", rng.normal(0, 0.45, (steps, n * n, 7, 2)).astype(np.float32))
        np.save(m / "zcor.npy", np.broadcast_to(z, (steps, n * n, 7)).astype(np.float32))
    return surf, nat


COLUMN = {
    "schema_version": "1.0.0", "analysis_kind": "water_column_multivariate_svd", "analysis_label": "demo_v1",
    "domain": {"flow_domain_id": "demo", "bbox_lon_lat": [119.9, 120.1, 21.9, 22.1], "center_lonlat": [120.015, 22.015]},
    "input": {"years": [2025], "months": [1, 2], "expected_timestep_hours": 1.0, "time_axis_canonicalization_policy": "reject"},
    "vertical_sampling": {"fixed_depths_m_below_vertical_datum": [10, 20, 30, 40, 50], "vertical_quadrature_weights_m": [5, 10, 10, 10, 10, 5]},
    "mask_and_missing_data": {"minimum_feature_valid_fraction": 1.0, "minimum_retained_time_fraction": 1.0, "minimum_cells_per_velocity_level": 4, "minimum_eta_cells": 4},
    "svd": {"requested_mode_count": 20, "minimum_reported_mode_count": 20},
    "solver": {"dense_memory_limit_gib": 1.0, "operator_time_block_rows": 16}, "figures": {},
}


def test_column_run_layout_and_recovery(spark, tmp_path, monkeypatch):
    surf, nat = column_caches(tmp_path)
    config = column_config(COLUMN)
    seen = column.preflight(spark, config, str(nat), str(surf))
    assert seen["candidate_features"] == 208 and seen["times"] == 48 and seen["node_runs"] == 1
    out = column.run(spark, config, str(nat), str(surf), str(tmp_path / "out"))
    meta = runs.read_metadata(spark, out)
    assert meta["solver"] == "dense" and meta["selection"]["features"] == 208 and meta["left_residual"] < 1e-8
    # by numpy: eta, then u of all levels, then v
    f, g = surf / "demo" / "months", nat / "demo" / "months"
    both = lambda base, name: np.concatenate([np.load(base / m / f"{name}.npy") for m in ("202501", "202502")]).astype(float)
    eta, top = both(f, "eta_m").reshape(48, 16), {c: both(f, f"{c}_surface_mps").reshape(48, 16) for c in "uv"}
    vel = both(g, "hvel")
    parts, w = [eta], [np.full(16, 1e3)]
    for k, c in enumerate("uv"):
        for i, weight in enumerate((5, 10, 10, 10, 10, 5)):
            parts.append(top[c] if i == 0 else vel[:, :, 6 - i, k])
            w.append(np.full(16, np.sqrt(1e6 * weight)))
    a, w = np.concatenate(parts, axis=1).T, np.concatenate(w)
    a = a - a.mean(axis=1, keepdims=True)
    for group in (slice(0, 16), slice(16, 208)):
        a[group] /= np.sqrt((a[group] ** 2 * w[group, None] ** 2).sum() / (48 * (w[group] ** 2).sum()))
    s = np.linalg.svd(a * w[:, None], compute_uv=False)
    t = products.validated(spark, out)
    assert np.allclose([r["sigma"] for r in t["spectrum"].orderBy("mode").collect()], s[:20], rtol=1e-6)
    layout = products.host_layout(spark, out, str(tmp_path / "out"))
    lon, lat = products.read_feature_index(spark, f"{layout}/feature_index_map")
    assert lon.count() == 4 and lat.count() == 4
    first = spark.read.csv(f"{layout}/feature_index_map", header=True)
    assert len(first.columns) == 14 and first.where("host_feature_index_zero_based = 0").first()["component"] == "eta"
    bundle = products.figure_tables(spark, out, 1, 3)
    assert bundle["limits"].count() == 3 * 7 and bundle["coverage"].count() == 13
    # a failing solver leaves a recovery folder; going on from it reads no cache
    raw = copy.deepcopy(COLUMN)
    raw["analysis_label"] = "demo_v2"
    monkeypatch.setattr(column, "solve", lambda *a: (_ for _ in ()).throw(RuntimeError("no")))
    with pytest.raises(RuntimeError):
        column.run(spark, column_config(raw), str(nat), str(surf), str(tmp_path / "out"))
    monkeypatch.undo()
    kept = next(p for p in (tmp_path / "out" / "water_column_svd").iterdir() if "recovery" in p.name)
    monkeypatch.setattr(arrays, "native", None)
    again = column.run(spark, column_config(raw), str(nat), str(surf), str(tmp_path / "out"), resume=str(kept))
    assert np.allclose([r["sigma"] for r in spark.read.parquet(f"{again}/spectrum").orderBy("mode").collect()], s[:20], rtol=1e-6)
    raw["svd"]["requested_mode_count"] = 21
    raw["analysis_label"] = "demo_v3"
    with pytest.raises(ContractError):
        column.run(spark, column_config(raw), str(nat), str(surf), str(tmp_path / "out"), resume=str(kept))


def test_fallback_keeps_only_complete_features(spark):
    rows = [(t, "eta", -1, 0, c, 1.0 * t) for t in range(4) for c in range(2) if (t, c) != (2, 1)]
    rows += [(t, k, lv, 0, 0, 1.0 * t) for t in range(4) for k in "uv" for lv in range(6)]
    values = spark.createDataFrame(rows, "t long, component string, level int, row int, col int, x double")
    layout = spark.createDataFrame([(k, lv, 0, 0, 1.0, 0) for k in "uv" for lv in range(6)] + [("eta", -1, 0, c, 1.0, 1) for c in range(2)], "component string, level int, row int, col int, weight double, feature_group int")
    raw = copy.deepcopy(COLUMN)
    raw["mask_and_missing_data"] = {"minimum_feature_valid_fraction": 0.5, "minimum_retained_time_fraction": 1.0, "minimum_cells_per_velocity_level": 1, "minimum_eta_cells": 1}
    raw["svd"] = {"requested_mode_count": 2, "minimum_reported_mode_count": 1}
    s = column.select(values, layout, spark.createDataFrame([(t, 0, t) for t in range(4)], "t long, ordinal int, src long"), column_config(raw))
    assert s.policy.startswith("complete_feature") and s.report["features"] == 13 and len(s.axis) == 4


def test_configuration_errors(tmp_path):
    for path, value in ((("svd", "requested_mode_count"), True), (("focus", "bbox_lon_lat"), [1, 1, 2, 3]), (("mask_and_missing_data", "minimum_retained_time_fraction"), 1.5), (("schema_version",), "2.0.0"), (("input", "months"), [1, 1])):
        raw = copy.deepcopy(SURFACE)
        at = raw
        for k in path[:-1]:
            at = at[k]
        at[path[-1]] = value
        with pytest.raises(ContractError):
            surface_config(raw)
    raw = copy.deepcopy(COLUMN)
    raw["analysis_label"] = "no version"
    with pytest.raises(ContractError):
        column_config(raw)
    with pytest.raises(SystemExit):
        parser().parse_args(["column", "--config", "c", "--native-root", "n", "--surface-root", "s", "--output-root", "o", "--preflight", "--resume-partial", "x"])


def test_run_log_and_stopwatch(spark, tmp_path):
    with pytest.raises(SystemExit), runs.RunLog(spark, str(tmp_path / "log.json"), {"a": 1}) as log:
        log.event("began")
        raise SystemExit(7)
    assert json.loads((tmp_path / "log.json").read_text())["exit_code"] == 7
    watch = runs.Stopwatch()
    with watch.measure("x"):
        pass
    with pytest.raises(ContractError), watch.measure("x"):
        pass
    with pytest.raises(RuntimeError):
        runs.publish(spark, str(tmp_path / "final"), lambda p: (_ for _ in ()).throw(RuntimeError("no")))
    assert not list(tmp_path.glob(".final*"))
