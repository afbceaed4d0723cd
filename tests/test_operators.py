import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modewave.errors import ContractError
from modewave.functions import scalar
from modewave.operators import blocks, features, gapfill, geometry, masks, modes, regrid, solvers, timeaxis

H = scalar.NS_PER_HOUR


def axis(spark, times):
    return spark.createDataFrame([(i, t) for i, t in enumerate(times)], "src long, t long")


def test_non_finite_values_become_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in df.select(scalar.finite_or_null("x").alias("x")).collect()] == [1.0, None, None, None]
    assert df.select(scalar.finite_or_null("x").alias("x")).agg(F.avg("x")).first()[0] == 1.0


def test_times_and_hashes(spark):
    ns = scalar.parse_utc_ns("2025-06-30T01:00:00Z")
    df = spark.createDataFrame([(ns,)], "t long")
    assert df.select(scalar.iso_utc("t")).first()[0] == "2025-06-30T01:00:00Z"
    assert scalar.sha256_json({"b": 1, "a": float("nan")}) == scalar.sha256_json({"a": None, "b": 1})
    assert scalar.sha256_json({"a": 1, "figures": 2}, ("figures",)) == scalar.sha256_json({"a": 1})
    with pytest.raises(ValueError):
        scalar.parse_utc_ns("2025-06-30T01:00:00")
    assert spark.createDataFrame([("海 v.1",)], "x string").select(scalar.safe_label("x")).first()[0] == scalar.safe_label_text("海 v.1")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=2, max_size=20))
def test_canonical_axis_equals_stable_sort(spark, times):
    got, report = timeaxis.canonicalize(axis(spark, times))
    t = np.array(times)
    order = np.argsort(t, kind="stable")
    ends = np.r_[np.diff(t[order]) != 0, True]
    assert sorted((r["t"], r["src"]) for r in got.collect()) == list(zip(t[order][ends].tolist(), order[ends].tolist(), strict=True))
    assert report.reordered == int((order != np.arange(len(t))).sum()) and report.dropped == len(t) - int(ends.sum())


def test_reject_policy_and_cadence(spark):
    with pytest.raises(ContractError):
        timeaxis.canonicalize(axis(spark, [0, 2, 1]), "reject")
    a = axis(spark, [0, H, 2 * H, 27 * H, 28 * H])
    c = timeaxis.validate_cadence(a, 1.0)
    assert (c.median_hours, c.maximum_hours, c.breaks) == (1.0, 25.0, 1)
    with pytest.raises(ContractError):
        timeaxis.validate_cadence(a, 1.0, 24.0)
    with pytest.raises(ContractError):
        timeaxis.validate_cadence(a, 2.0)
    assert [r["segment"] for r in timeaxis.segments(a, 1.0).orderBy("t").collect()] == [0, 0, 0, 1, 1]
    assert timeaxis.is_increasing(a) and not timeaxis.is_increasing(axis(spark, [1, 1]))


def test_repair_asks_for_exact_bounds(spark):
    a = spark.createDataFrame([("202502", i, i * H) for i in range(6)], "month string, src long, t long")
    good = timeaxis.Repair("202502", 0, 2, -24 * H, 0, H)
    out, n = timeaxis.repair(a, [good])
    assert n == 2 and [r["t"] // H for r in out.orderBy("src").collect()] == [-24, -23, 2, 3, 4, 5]
    with pytest.raises(ContractError):
        timeaxis.repair(a, [timeaxis.Repair("202502", 0, 2, -24 * H, 0, 2 * H)])
    with pytest.raises(ContractError):
        timeaxis.repair(a, [timeaxis.Repair("202502", 0, 2, 24 * H, 0, H)])


def loop_fill(values, k):
    """The rule, one cell after another."""
    out, done = values.copy(), np.zeros(values.shape[0], dtype=bool)
    missing = np.isnan(values).any(axis=1)
    i = 0
    while i < len(values):
        j = i
        while j < len(values) and missing[j]:
            j += 1
        if j > i and i > 0 and j < len(values) and j - i <= k:
            for n in range(i, j):
                out[n] = values[i - 1] + (n - i + 1) / (j - i + 1) * (values[j] - values[i - 1])
                done[n] = True
        i = max(j, i + 1)
    return out, done


@settings(max_examples=6, deadline=None)
@given(st.integers(0, 10_000), st.integers(0, 3))
def test_gap_filling_equals_the_loop(spark, seed, k):
    rng = np.random.default_rng(seed)
    cells = {c: np.where(rng.random((14, 1)) < 0.35, np.nan, rng.normal(size=(14, 2))) for c in range(3)}
    rows = [(c, t, *(None if math.isnan(x) else float(x) for x in v[t])) for c, v in cells.items() for t in range(14)]
    df = spark.createDataFrame(rows, "cell int, t long, u double, v double")
    got = gapfill.fill_short_gaps(df, ("u", "v"), k, ("cell",)).collect()
    want = {c: loop_fill(v, k) for c, v in cells.items()}
    for r in got:
        x, done = want[r["cell"]]
        assert r["imputed"] == bool(done[r["t"]])
        for name, value in zip(("u", "v"), x[r["t"]], strict=True):
            assert (r[name] is None) == math.isnan(value) and (r[name] is None or abs(r[name] - value) < 1e-12)


def test_axes_in_parts_equal_axes_as_a_whole(spark, monkeypatch):
    monkeypatch.setattr(timeaxis, "PART_ROWS", 7)
    rng = np.random.default_rng(4)
    times = [int(x) * H for x in np.r_[rng.integers(0, 60, 90), rng.integers(500, 520, 30)]]
    a = axis(spark, times)
    got, report = timeaxis.canonicalize(a)
    t = np.array(times)
    order = np.argsort(t, kind="stable")
    assert report.reordered == int((order != np.arange(len(t))).sum()) and report.rows_out == len(set(times))
    distinct = sorted(set(times))
    lag = {r["t"]: r["gap_hours"] for r in timeaxis.lags(got).collect()}
    assert lag == {b: None if a is None else (b - a) / H for a, b in zip([None, *distinct], distinct, strict=False)}
    segment, want = 0, {}
    for x, y in zip([None, *distinct], distinct, strict=False):
        segment += x is not None and y - x > 1.5 * H
        want[y] = segment
    assert {r["t"]: r["segment"] for r in timeaxis.segments(got, 1.0).collect()} == want
    assert not timeaxis.is_increasing(a) and timeaxis.is_increasing(axis(spark, distinct))
    for df in (timeaxis.lags(got), timeaxis.segments(got, 1.0), timeaxis.reordered(a)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "SinglePartition" not in plan


def test_gap_filling_is_linear(spark):
    """One cell of 40,000 steps with frames as long as a gap may be."""
    df = spark.range(40_000).select(F.lit(0).alias("cell"), F.col("id").alias("t"), F.when(F.col("id") % 5 != 3, F.col("id").cast("double")).alias("u"))
    plan = gapfill.fill_short_gaps(df, ("u",), 2, ("cell",))._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedfollowing" not in plan
    began = time.monotonic()
    assert gapfill.fill_short_gaps(df, ("u",), 2, ("cell",)).agg(F.count_if("imputed"), F.max(F.abs(F.col("u") - F.col("t")))).first()[:] == (8000, 0.0)
    assert time.monotonic() - began < 30


def test_large_covariances_go_to_a_direct_solver(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=(200, 6))
    m = blocks.from_rows(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(a)], "k long, v array<double>"), 6, "v", "k")
    s = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(solvers.by_covariance(m, 3).s, s[:3], rtol=1e-9) and np.allclose(solvers.by_covariance(m, 3, memory_bytes=100).s, s[:3], rtol=1e-9)
    assert solvers.by_covariance(m, 3, memory_bytes=100).solver != "covariance_eigh"
    assert "Window" not in m.blocks._jdf.queryExecution().executedPlan().toString()


def test_krylov_basis_is_cut_back(spark):
    """A basis of three blocks at most: more passes, the same modes."""
    rng = np.random.default_rng(9)
    a = rng.normal(size=(90, 40)) @ np.diag(0.8 ** np.arange(40)) @ rng.normal(size=(40, 40))
    m = blocks.kept(blocks.from_rows(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(a)], "k long, v array<double>"), 40, "v", "k"))
    s = np.linalg.svd(a, compute_uv=False)
    got = solvers.krylov(m, 4, basis_bytes=1, rounds=20)
    assert np.allclose(got.s, s[:4], rtol=1e-9) and max(got.left_residual, got.right_residual) < 1e-8 and got.orthogonality < 1e-10


def test_solvers_bring_nothing_as_long_as_the_axis_to_the_driver(spark, monkeypatch):
    """The driver gets the same bytes for four times the times; right vectors come when asked for."""
    frame, got = type(spark.range(0)), []
    whole = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: (rows := whole(self), got.extend(len(x) for r in rows for x in r if isinstance(x, bytes | bytearray)))[0])
    rng = np.random.default_rng(10)
    for solve in (solvers.krylov, solvers.qr_tree, solvers.by_covariance):
        seen = []
        for n in (1000, 4000):
            a = rng.normal(size=(n, 5)) * np.geomspace(1, 1e-3, 5)
            df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(a)], "k long, v array<double>")
            m = blocks.kept(blocks.from_rows(df, 5, "v", "k"))
            got.clear()
            found = solve(m, 5)
            seen.append(sum(got))
            assert np.allclose(found.s, np.linalg.svd(a, compute_uv=False), rtol=1e-8)
            if solve is not solvers.by_covariance:
                assert max(found.left_residual, found.right_residual) < 1e-8 and found.orthogonality < 1e-10
        assert seen[0] == seen[1] < 8 * 1000
        assert np.allclose(found.v.T @ found.v, np.eye(5), atol=1e-8) and np.allclose(found.u * found.s @ found.v.T, blocks.collected(m), atol=1e-8)


def test_weak_modes_keep_their_precision(spark):
    """Singular values over seven decades: both solvers pass their gates, and numpy's values hold."""
    rng = np.random.default_rng(11)
    q = np.linalg.qr(rng.normal(size=(300, 8)))[0] * np.geomspace(1, 1e-7, 8) @ np.linalg.qr(rng.normal(size=(8, 8)))[0]
    m = blocks.kept(blocks.from_rows(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "k long, v array<double>"), 8, "v", "k"))
    for got in (solvers.krylov(m, 8), solvers.qr_tree(m, 8)):
        assert np.allclose(got.s, np.geomspace(1, 1e-7, 8), rtol=1e-7) and got.orthogonality < 1e-10
        assert np.allclose(got.v.T @ got.v, np.eye(8), atol=1e-10)


def test_arrows_keep_off_the_edges(spark):
    g = spark.createDataFrame([(r, c, 120 + 0.1 * c, 22 + 0.1 * r, 1.0, float("nan") if (r, c) == (4, 4) else 1.0) for r in range(9) for c in range(9)], "row int, col int, lon double, lat double, u double, v double")
    extent = masks.map_extent(g, (119.0, 120.82, 21.0, 23.0), 0.1, 0.1)
    assert extent == pytest.approx((119.95, 120.82, 21.95, 22.85))
    got = {(r["row"], r["col"]) for r in masks.thinned(g, 2, extent).collect()}
    lon, lat = 0.06 * 0.87, 0.06 * 0.9
    want = {(r, c) for r in range(0, 9, 2) for c in range(0, 9, 2) if (r, c) != (4, 4) and 119.95 + lon <= 120 + 0.1 * c <= 120.82 - lon and 21.95 + lat <= 22 + 0.1 * r <= 22.85 - lat}
    assert got == want and (0, 2) not in got and (2, 8) not in got


def test_gap_filling_by_time_does_not_cross_a_break(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (0, 30, 2.0)], "cell int, t long, u double")
    assert gapfill.fill_short_gaps(df, ("u",), 2, ("cell",)).where("imputed").count() == 1
    assert gapfill.fill_short_gaps(df, ("u",), 2, ("cell",), basis="time", step=1.0).where("imputed").count() == 0


def test_vertical_interpolation(spark):
    rows = [(1, 0, -5.0, 1.0, 10.0), (1, 1, -15.0, 3.0, 30.0), (1, 2, None, 9.0, 9.0), (2, 0, -10.0, 7.0, 7.0), (3, 0, -20.0, 1.0, 1.0), (4, 1, -10.0, 5.0, 5.0), (4, 0, -10.0, 4.0, 4.0)]
    df = spark.createDataFrame(rows, "col int, layer int, z double, u double, v double")
    got = {r["col"]: (r["u"], r["v"], r["span"]) for r in regrid.at_depths(df, {"d": -10.0}, ("col",)).collect()}
    assert got[1] == (2.0, 20.0, 10.0)  # between
    assert got[2] == (7.0, 7.0, 0.0)  # on a layer
    assert got[3] == (None, None, None)  # no extrapolation
    assert got[4][0] == 4.0  # of equal layers the lowest number


def test_barycentric(spark):
    mesh = spark.createDataFrame([(0, 0, 0, 1, 0.2), (0, 0, 1, 2, 0.3), (0, 0, 2, 2, 0.5), (0, 1, 0, 1, 1.0), (0, 1, 1, -1, 0.0), (0, 1, 2, 1, 0.0), (1, 0, 0, 3, 0.5), (1, 0, 1, 1, 0.5), (1, 0, 2, 1, 0.0)], "row int, col int, slot int, node long, weight double")
    nodes = spark.createDataFrame([(1, 0, 10.0), (2, 0, 20.0), (3, 0, float("nan"))], "node long, t long, u double")
    got = {(r["row"], r["col"]): r["u"] for r in regrid.barycentric(nodes, mesh, ("t",), ("u",)).collect()}
    assert got[0, 0] == pytest.approx(18.0) and got[0, 1] is None and got[1, 0] is None
    assert {tuple(r) for r in masks.supported_cells(mesh).collect()} == {(0, 0), (1, 0)}
    assert regrid.island_count(spark.createDataFrame([(x,) for x in (1, 2, 3, 7, 9, 10)], "x long"), "x") == 3


def test_boxes_and_nearest(spark):
    g = spark.createDataFrame([(r, c, 120 + 0.01 * c, 22 + 0.01 * r) for r in range(5) for c in range(5)], "row int, col int, lon double, lat double")
    assert masks.snap_axis(g.select("col", "lon").distinct(), "lon", "col", 120.015, 120.025) == (1, 4)
    assert masks.snap_axis(g.select("col", "lon").distinct(), "lon", "col", 119.0, 121.0) == (0, 5)
    with pytest.raises(ContractError):
        masks.snap_axis(g.select("col", "lon").distinct(), "lon", "col", 130.0, 131.0)
    assert masks.geometry(g, (120.01, 120.03, 22.01, 22.03)).where("inside").count() == 9
    assert masks.nearest(g, 120.02, 22.02).select("row", "col").first() == (2, 2)
    assert masks.eligible("ready", "standard_month") and not masks.eligible("ready", "standard_partial_month")
    assert masks.eligible("ready", "standard_partial_month", allow_partial=True) and masks.eligible("trial_ready", "trial_partial_month", allow_trial=True)


def matrix(spark, a, width=7):
    rows = [(f, t, float(a[f, t])) for f in range(a.shape[0]) for t in range(a.shape[1])]
    return blocks.to_blocks(spark.createDataFrame(rows, "feature_id long, t_idx long, x double"), *a.shape, width)


def test_solvers_agree_with_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(12, 60)) * np.geomspace(1, 1e-4, 12)[:, None]
    m = matrix(spark, a)
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    for got in (solvers.dense(m, 5), solvers.qr_tree(m, 5), solvers.krylov(m, 5)):
        assert np.allclose(got.s, s[:5], rtol=1e-10)
        assert np.allclose(np.abs((got.u * u[:, :5]).sum(axis=0)), 1, atol=1e-8)
        assert max(got.left_residual, got.right_residual) < 1e-8 and got.orthogonality < 1e-10
    cov = solvers.by_covariance(m, 12)
    assert np.allclose(cov.s[:5], s[:5], rtol=1e-8) and abs(cov.all_ev.sum() - 1) < 1e-10
    assert np.allclose(cov.pc, cov.u.T @ a, atol=1e-9)
    assert solvers.direct(m, 3, memory_bytes=1).solver == "qr_tree" and solvers.direct(m, 3).solver == "dense"
    with pytest.raises(ContractError):
        solvers.by_covariance(matrix(spark, np.outer(np.arange(1, 5), np.sin(np.arange(20)))), 3, 2)


def test_krylov_retries_and_gives_up(spark):
    a = np.random.default_rng(2).normal(size=(60, 80))
    with pytest.raises(RuntimeError):
        solvers.krylov(matrix(spark, a, 40), 3, rounds=1, attempts=1)


def test_missing_elements_raise(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.0)], "feature_id long, t_idx long, x double")
    with pytest.raises(Exception, match="missing"):
        blocks.to_blocks(df, 2, 2).blocks.collect()


def test_signs_fall_back():
    u = np.array([[-0.5, 0.0], [0.5, 0.0], [0.1, -0.9]])
    s, why = modes.signs(u, [("u", 0), ("v", 1)])
    assert s.tolist() == [-1.0, -1.0] and why == ["u", "largest_absolute_loading"]
    std, dev, mean = modes.standardised(np.array([[1.0, 2.0, 3.0]]))
    assert np.allclose(std, [[-1, 0, 1]]) and dev.tolist() == [1.0] and mean == 2.0
    with pytest.raises(ContractError):
        modes.standardised(np.ones((1, 3)))


def test_feature_orders(spark):
    f = spark.createDataFrame([(c, lv, 0, 0) for c, lv in (("u", 0), ("u", 1), ("v", 0), ("v", 1), ("eta", -1))], "component string, level int, row int, col int")
    order = [r["component"] for r in features.feature_map(f, features.COLUMN_ORDER).orderBy("feature_id").collect()]
    assert order == ["eta", "u", "u", "v", "v"]


def test_pairs_stay_together(spark):
    f = spark.createDataFrame([("u", 0, 0, 0, 1.0), ("v", 0, 0, 0, 0.5), ("u", 0, 0, 1, 1.0), ("v", 0, 0, 1, 0.9), ("eta", -1, 0, 0, 0.95)], "component string, level int, row int, col int, fraction double")
    assert {(r["component"], r["col"]) for r in masks.paired_selection(f, 0.9).collect()} == {("u", 1), ("v", 1), ("eta", 0)}


def test_polygons(spark, tmp_path):
    import json

    shape = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [4, 0], [4, 4], [0, 4]], [[1, 1], [3, 1], [3, 3], [1, 3], [1, 1]]]]}}, {"type": "Feature", "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [0, 0]}]}}]}
    rings = geometry.polygons(shape)
    assert len(rings) == 1 and len(rings[0]) == 2 and rings[0][0][0] == rings[0][0][-1]
    out = geometry.clip_all(rings, (0.0, 2.0, 0.0, 2.0))
    assert len(out[0]) == 2
    with pytest.raises(ContractError):
        geometry.clip_all(rings, (50.0, 51.0, 50.0, 51.0))
    with pytest.raises(ContractError):
        geometry.closed([[0, 0], [1, 200], [1, 1]])
    (tmp_path / "x.geojson").write_text(json.dumps(shape))
    df = geometry.clip_rings(geometry.read_geojson(spark, str(tmp_path / "x.geojson")), (0.0, 2.0, 0.0, 2.0))
    assert sorted(round(r[0], 9) for r in df.select(geometry.ring_area()).collect()) == [1.0, 4.0]


def test_compass(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0), (1.0, 1.0), (1.0, -1.0)], "u double, v double")
    assert [r[0] for r in df.select(scalar.compass(F.col("u"), F.col("v"))).collect()] == ["E", "N", "W", "S", "NE", "SE"]
