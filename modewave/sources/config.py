"""Run configurations: JSON in, checked dataclasses out."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from ..errors import require
from ..functions.scalar import NS_PER_HOUR, parse_utc_ns
from ..operators.timeaxis import Repair

SCHEMA_VERSION = "1.0.0"
#: Depths of the six velocity levels, and their names. Level 0 is the published surface current.
LEVEL_DEPTHS = (0.0, 10.0, 20.0, 30.0, 40.0, 50.0)
LEVEL_IDS = ("surface", "z_minus_010m", "z_minus_020m", "z_minus_030m", "z_minus_040m", "z_minus_050m")


def read_json(path: str | Path) -> dict[str, Any]:
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    require(isinstance(value, dict), f"{path}: not a JSON object")
    return value


def number(value: Any, name: str) -> float:
    require(isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value), f"{name}: not a finite number")
    return float(value)


def positive_int(value: Any, name: str, least: int = 1) -> int:
    require(isinstance(value, int) and not isinstance(value, bool) and value >= least, f"{name}: not an integer of at least {least}")
    return value


def fraction(value: Any, name: str) -> float:
    x = number(value, name)
    require(0.0 <= x <= 1.0, f"{name}: not between 0 and 1")
    return x


def box(value: Any, name: str) -> tuple[float, float, float, float]:
    require(isinstance(value, list) and len(value) == 4, f"{name}: four numbers")
    a, b, c, d = (number(x, name) for x in value)
    require(a < b and c < d, f"{name}: lon_min < lon_max and lat_min < lat_max")
    return a, b, c, d


def point(value: Any, name: str) -> tuple[float, float]:
    require(isinstance(value, list) and len(value) == 2, f"{name}: two numbers")
    return number(value[0], name), number(value[1], name)


def unique_ints(value: Any, name: str, low: int, high: int) -> tuple[int, ...]:
    require(isinstance(value, list) and bool(value), f"{name}: a list")
    out = tuple(positive_int(x, name) for x in value)
    require(len(set(out)) == len(out) and all(low <= x <= high for x in out), f"{name}: distinct, {low} to {high}")
    return tuple(sorted(out))


def sha256_hex(value: Any, name: str) -> str:
    require(isinstance(value, str) and re.fullmatch(r"[0-9a-f]{64}", value) is not None, f"{name}: 64 hexadecimal digits")
    return value


@dataclass(frozen=True)
class Input:
    """Which months, and what their time axis must look like."""

    years: tuple[int, ...]
    months: tuple[int, ...]
    step_hours: float
    maximum_gap_hours: float | None
    policy: str
    required_kinds: frozenset[str]
    schema_major: int
    repairs: tuple[Repair, ...] = ()

    @property
    def month_ids(self) -> list[str]:
        return [f"{y:04d}{m:02d}" for y in self.years for m in self.months]


def _years(raw: dict[str, Any]) -> tuple[int, ...]:
    """``years`` in rising order, or the older single ``year``; where both stand, the single one is the last."""
    one, many = raw.get("year"), raw.get("years")
    if many is None:
        return (positive_int(one, "year"),)
    require(isinstance(many, list) and bool(many), "years: a list")
    out = tuple(positive_int(y, "years") for y in many)
    require(all(a < b for a, b in zip(out, out[1:], strict=False)), "years: distinct, in rising order")
    require(one is None or positive_int(one, "year") == out[-1], "year is not the last of years")
    return out


def text(value: Any, name: str) -> str:
    require(isinstance(value, str) and bool(value.strip()), f"{name}: a text that is not blank")
    return value


def _input(raw: dict[str, Any]) -> Input:
    gap = raw.get("maximum_source_gap_hours")
    policy = raw.get("time_axis_canonicalization_policy", "reject")
    require(policy in ("reject", "sort_and_deduplicate_prefer_last"), f"unknown policy {policy}")
    months = unique_ints(raw["months"], "months", 1, 12)
    years = _years(raw)
    ids = {f"{y:04d}{m:02d}" for y in years for m in months}
    repairs = []
    for r in raw.get("known_time_axis_repairs") or []:
        start, stop = positive_int(r["start_index"], "start_index", 0), positive_int(r["stop_index"], "stop_index")
        require(r["month"] in ids and start < stop, "a repair's month and rows")
        shift = number(r["shift_hours"], "shift_hours")
        repairs.append(Repair(r["month"], start, stop, round(shift * NS_PER_HOUR), parse_utc_ns(r["expected_original_start_utc"]), parse_utc_ns(r["expected_original_end_utc"])))
    return Input(
        years, months, number(raw["expected_timestep_hours"], "expected_timestep_hours"), None if gap is None else number(gap, "maximum_source_gap_hours"), policy,
        frozenset(raw.get("required_cache_kinds", ["standard_month"])), positive_int(raw.get("required_cache_schema_major", 3), "required_cache_schema_major"), tuple(repairs),
    )


@dataclass(frozen=True)
class SurfaceConfig:
    raw: dict[str, Any] = field(repr=False)
    label: str
    domain: str
    region: str
    approval: str
    box: tuple[float, float, float, float]
    anchor: tuple[float, float]
    mask_policy: str
    input: Input
    least_cells: int
    least_cell_fraction: float
    max_gap_steps: int
    least_time_fraction: float
    modes: int
    least_modes: int
    unit_id: str | None = None
    source_config: str | None = None
    source_sha256: str | None = None
    threads: int | None = None
    io_workers: int | None = None


def surface_config(value: dict[str, Any] | str | Path) -> SurfaceConfig:
    raw = value if isinstance(value, dict) else read_json(value)
    require(raw.get("schema_version") == SCHEMA_VERSION, "schema_version")
    require(raw.get("analysis_kind") == "surface_multivariate_svd", "analysis_kind")
    focus, mask, svd = raw["focus"], raw["mask_and_missing_data"], raw["svd"]
    policy = focus.get("spatial_mask_policy", "reader_window")
    require(policy in ("reader_window", "analysis_bbox_cell_center"), f"unknown spatial policy {policy}")
    own, anchor = box(focus["bbox_lon_lat"], "bbox_lon_lat"), point(focus["anchor_lonlat"], "anchor_lonlat")
    least = positive_int(svd["minimum_reported_mode_count"], "minimum_reported_mode_count")
    modes = positive_int(svd["requested_mode_count"], "requested_mode_count")
    require(modes >= least, "more modes must be reported than are asked for")
    require(own[0] <= anchor[0] <= own[1] and own[2] <= anchor[1] <= own[3], "the anchor lies outside of the box")
    if policy == "analysis_bbox_cell_center" and "source_analysis_units_config_sha256" in focus:
        text(focus.get("analysis_unit_id"), "analysis_unit_id")
    cores = raw.get("parallel_execution", {})
    require(isinstance(cores, dict), "parallel_execution: an object")
    threads, workers = (None if cores.get(k) is None else positive_int(cores[k], k) for k in ("linear_algebra_threads", "io_workers"))
    return SurfaceConfig(
        raw, str(raw["analysis_label"]), str(focus["flow_domain_id"]), str(focus["focus_id"]), str(focus.get("approval_status", "candidate")), own, anchor, policy, _input(raw["input"]),
        positive_int(mask["minimum_static_ocean_cells"], "minimum_static_ocean_cells"), fraction(mask["minimum_cell_triplet_valid_fraction"], "minimum_cell_triplet_valid_fraction"),
        positive_int(mask["max_consecutive_missing_timesteps_to_interpolate"], "max_consecutive_missing_timesteps_to_interpolate", 0),
        fraction(mask["minimum_retained_time_fraction"], "minimum_retained_time_fraction"), modes, least,
        focus.get("analysis_unit_id"), focus.get("source_analysis_units_config"),
        sha256_hex(focus["source_analysis_units_config_sha256"], "source_analysis_units_config_sha256") if focus.get("source_analysis_units_config_sha256") else None,
        threads, workers,
    )


@dataclass(frozen=True)
class ColumnConfig:
    """A water-column run: six velocity levels and one surface height in one matrix."""

    raw: dict[str, Any] = field(repr=False)
    label: str
    domain: str
    box: tuple[float, float, float, float]
    centre: tuple[float, float]
    input: Input
    weights: tuple[float, ...]
    least_feature_fraction: float
    least_time_fraction: float
    least_level_cells: int
    least_eta_cells: int
    modes: int
    least_modes: int
    memory_bytes: int
    block_times: int
    attempts: int
    tolerance: float
    seed: int


def column_config(value: dict[str, Any] | str | Path) -> ColumnConfig:
    raw = value if isinstance(value, dict) else read_json(value)
    require(raw.get("schema_version") == SCHEMA_VERSION, "schema_version")
    require(raw.get("analysis_kind") == "water_column_multivariate_svd", "analysis_kind")
    label = str(raw["analysis_label"])
    require(re.search(r"_v\d+$", label) is not None, "the label must end in _v and a number")
    dom, mask, svd, sol, vert = raw["domain"], raw["mask_and_missing_data"], raw["svd"], raw["solver"], raw["vertical_sampling"]
    require(tuple(number(x, "depth") for x in vert["fixed_depths_m_below_vertical_datum"]) == LEVEL_DEPTHS[1:], "the fixed depths are 10 to 50 m")
    weights = tuple(number(x, "vertical weight") for x in vert["vertical_quadrature_weights_m"])
    require(len(weights) == len(LEVEL_DEPTHS) and all(w > 0 for w in weights), "six positive vertical weights")
    least, modes = positive_int(svd["minimum_reported_mode_count"], "minimum_reported_mode_count"), positive_int(svd["requested_mode_count"], "requested_mode_count")
    require(modes >= least, "more modes must be reported than are asked for")
    return ColumnConfig(
        raw, label, str(dom["flow_domain_id"]), box(dom["bbox_lon_lat"], "bbox_lon_lat"), point(dom["center_lonlat"], "center_lonlat"), _input(raw["input"]), weights,
        fraction(mask["minimum_feature_valid_fraction"], "minimum_feature_valid_fraction"), fraction(mask["minimum_retained_time_fraction"], "minimum_retained_time_fraction"),
        positive_int(mask["minimum_cells_per_velocity_level"], "minimum_cells_per_velocity_level"), positive_int(mask["minimum_eta_cells"], "minimum_eta_cells"), modes, least,
        int(number(sol["dense_memory_limit_gib"], "dense_memory_limit_gib") * (1 << 30)), positive_int(sol.get("operator_time_block_rows", 64), "operator_time_block_rows"),
        positive_int(sol.get("propack_max_attempts", 3), "propack_max_attempts"), number(sol.get("relative_residual_tolerance", 1e-9), "relative_residual_tolerance"), int(sol.get("random_seed", 0)),
    )


BATCH_KIND = "surface_multivariate_svd_batch"


@dataclass(frozen=True)
class BatchConfig:
    label: str
    configs: tuple[Path, ...]
    units: tuple[str, ...]
    source_config: str
    source_sha256: str
    least_cores: int
    max_concurrent: int
    threads: int
    io_workers: int


def batch_config(path: str | Path) -> BatchConfig:
    """Regions to run together: each once, all of the batch's source and with its threads, no more than run at once, within the cores they are planned for."""
    raw, base = read_json(path), Path(path).resolve().parent
    require(raw.get("schema_version") == SCHEMA_VERSION, "schema_version")
    require(raw.get("analysis_kind") == BATCH_KIND, "analysis_kind")
    label, source = text(raw.get("batch_label"), "batch_label"), text(raw.get("source_analysis_units_config"), "source_analysis_units_config")
    digest = sha256_hex(raw.get("source_analysis_units_config_sha256"), "source_analysis_units_config_sha256")
    plan, regions = raw.get("parallel_execution"), raw.get("region_configs")
    require(isinstance(plan, dict), "parallel_execution: an object")
    cores, most, threads, workers = (positive_int(plan.get(k), k) for k in ("server_minimum_cpu_cores", "max_concurrent_regions", "per_region_linear_algebra_threads", "per_region_io_workers"))
    require(most * threads <= cores, "more threads than cores")
    require(isinstance(regions, list) and bool(regions) and all(isinstance(x, dict) for x in regions), "region_configs: a list of objects")
    require(len(regions) <= most, "more regions than may run at once")
    units = tuple(text(x.get("analysis_unit_id"), "analysis_unit_id") for x in regions)
    paths = tuple((base / text(x.get("config"), "config")).resolve() for x in regions)
    require(len(set(units)) == len(units) and len(set(paths)) == len(paths), "a region is listed twice")
    for unit, p in zip(units, paths, strict=True):
        c = surface_config(p)
        require(c.unit_id == unit, f"{p.name}: another analysis unit")
        require((c.source_config, c.source_sha256) == (source, digest), f"{p.name}: another source of analysis units")
        require((c.threads, c.io_workers) == (threads, workers), f"{p.name}: threads or workers are not the batch's")
    return BatchConfig(label, paths, units, source, digest, cores, most, threads, workers)
