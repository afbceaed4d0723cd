"""Time axes: order, duplicates, cadence, registered repairs, segments.

An axis is (src, t): the place of a record in its source, and its time in nanoseconds. Orders over a whole axis are taken
in parts: equal ranges of the ordering column, ranked apart, and put together from one row per part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import require
from ..functions.scalar import hours


@dataclass(frozen=True)
class Canonicalized:
    policy: str
    rows_in: int
    rows_out: int
    reordered: int
    dropped: int


@dataclass(frozen=True)
class Cadence:
    median_hours: float
    maximum_hours: float
    breaks: int


def prefer_last(rows: DataFrame, time: str, src: str, *keys: str) -> DataFrame:
    """Of rows with one time (and keys), the last in source order. A partial aggregate finds it; no window over the rows."""
    others = [c for c in rows.columns if c not in (time, src, *keys)]
    packed = F.max(F.struct(src, *others)).alias("last") if others else F.max(F.struct(src)).alias("last")
    return rows.groupBy(time, *keys).agg(packed).select(time, *keys, "last.*")


#: Rows of a part of an axis, about, and parts at most, which bounds what the driver sees.
PART_ROWS, MOST_PARTS = 100_000, 4096


def in_parts(axis: DataFrame, by: str) -> tuple[DataFrame, int]:
    """Adds ``part``: equal ranges of the column ``by``, so parts follow one another in its order."""
    r = axis.agg(F.count(F.lit(1)).alias("n"), F.min(by).alias("a"), F.max(by).alias("b")).first()
    n = max(1, min(MOST_PARTS, -(-r["n"] // PART_ROWS)))
    width = float(r["b"] - r["a"]) + 1.0 if r["n"] else 1.0
    at = F.floor((F.col(by) - F.lit(r["a"] or 0)).cast("double") * n / width)
    return axis.withColumn("part", F.coalesce(F.least(at, F.lit(n - 1)), F.lit(0)).cast("int")), n


def _known(parts: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """``parts`` with what the driver knows of each part: MOST_PARTS rows at most."""
    return parts.join(F.broadcast(parts.sparkSession.createDataFrame(rows, f"part int, {schema}")), "part", "left")


def placed(axis: DataFrame, by: str, *ties: str, name: str = "place") -> DataFrame:
    """Adds the place of each row, from 0, in the order of ``by`` and ``ties``."""
    parts, _ = in_parts(axis, by)
    before, rows = 0, []
    for r in parts.groupBy("part").count().orderBy("part").collect():
        rows.append((r["part"], before))
        before += r["count"]
    own = F.row_number().over(W.partitionBy("part").orderBy(by, *ties)) - 1
    return _known(parts.withColumn("own", own), rows, "before long").withColumn(name, F.col("own") + F.col("before")).drop("part", "own", "before")


def lagged(axis: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Adds the ``value`` of the row before in the order of ``by`` (null for the first)."""
    parts, _ = in_parts(axis, by)
    last, rows = None, []
    for r in parts.groupBy("part").agg(F.max_by(value, by).alias("last")).orderBy("part").collect():
        rows.append((r["part"], last))
        last = r["last"]
    own = F.lag(value).over(W.partitionBy("part").orderBy(by))
    return _known(parts.withColumn("own", own), rows, "last long").withColumn(name, F.coalesce("own", "last")).drop("part", "own", "last")


def reordered(axis: DataFrame, time: str = "t", src: str = "src") -> DataFrame:
    """Axis rows with their place in time order (ties by source) and whether that differs from their place in the source."""
    both = placed(placed(axis, time, src, name="place"), src, name="from")
    return both.withColumn("moved", F.col("place") != F.col("from")).drop("from")


def canonicalize(axis: DataFrame, policy: str = "sort_and_deduplicate_prefer_last", time: str = "t", src: str = "src") -> tuple[DataFrame, Canonicalized]:
    """A strictly increasing axis and what it took. Policy ``reject`` raises instead of repairing."""
    require(policy in ("reject", "sort_and_deduplicate_prefer_last"), f"unknown policy {policy}")
    seen = reordered(axis, time, src).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(time).alias("d"), F.count_if("moved").alias("m")).first()
    require(seen["n"] >= 2, "an axis needs two times")
    if policy == "reject":
        require(seen["n"] == seen["d"] and seen["m"] == 0, "the axis is not strictly increasing")
        return axis.select(src, time), Canonicalized(policy, seen["n"], seen["n"], 0, 0)
    out = axis.groupBy(time).agg(F.max(src).alias(src)).select(src, time)
    return out, Canonicalized(policy, seen["n"], seen["d"], seen["m"], seen["n"] - seen["d"])


def lags(axis: DataFrame, time: str = "t") -> DataFrame:
    """Adds ``gap_hours`` to the time before; null for the first."""
    return lagged(axis, time, time, "before_t").withColumn("gap_hours", hours(F.col(time) - F.col("before_t"))).drop("before_t")


def is_increasing(axis: DataFrame, time: str = "t", src: str = "src") -> bool:
    """Whether times rise strictly in source order."""
    low = lagged(axis.select(src, time), src, time, "before_t").agg(F.min(F.col(time) - F.col("before_t"))).first()[0]
    return low is None or low > 0


def cadence_stats(axis: DataFrame, expected_hours: float, time: str = "t") -> DataFrame:
    """One row: median_hours, maximum_hours, breaks (gaps beyond the expected step and its tolerance)."""
    tolerance = max(0.01, 0.01 * expected_hours)
    return lags(axis, time).agg(
        F.median("gap_hours").alias("median_hours"),
        F.max("gap_hours").alias("maximum_hours"),
        F.count_if(F.col("gap_hours") > expected_hours + tolerance).alias("breaks"),
    )


def validate_cadence(axis: DataFrame, expected_hours: float, maximum_gap_hours: float | None = None, time: str = "t") -> Cadence:
    r = cadence_stats(axis, expected_hours, time).first()
    require(r["median_hours"] is not None, "a cadence needs two times")
    require(abs(r["median_hours"] - expected_hours) <= max(0.01, 0.01 * expected_hours), f"median step {r['median_hours']:.6g} h, expected {expected_hours:.6g} h")
    if maximum_gap_hours is not None:
        require(r["maximum_hours"] <= maximum_gap_hours, f"gap of {r['maximum_hours']:.6g} h, at most {maximum_gap_hours:.6g} h")
    return Cadence(float(r["median_hours"]), float(r["maximum_hours"]), int(r["breaks"]))


def segments(axis: DataFrame, step_hours: float, time: str = "t", factor: float = 1.5, *keys: str) -> DataFrame:
    """Adds ``segment``: rows whose gaps stay within ``factor`` steps share one (gaps and islands)."""
    if keys:
        w = W.partitionBy(*keys).orderBy(time)
        new = F.coalesce((hours(F.col(time) - F.lag(time).over(w)) > factor * step_hours).cast("int"), F.lit(0))
        return axis.withColumn("new", new).withColumn("segment", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("new")
    marked, _ = in_parts(lags(axis, time).withColumn("new", F.coalesce((F.col("gap_hours") > factor * step_hours).cast("int"), F.lit(0))).drop("gap_hours"), time)
    before, rows = 0, []
    for r in marked.groupBy("part").agg(F.sum("new").alias("n")).orderBy("part").collect():
        rows.append((r["part"], before))
        before += r["n"]
    own = F.sum("new").over(W.partitionBy("part").orderBy(time).rowsBetween(W.unboundedPreceding, 0))
    return _known(marked.withColumn("own", own), rows, "before long").withColumn("segment", F.col("own") + F.col("before")).drop("new", "own", "before", "part")


@dataclass(frozen=True)
class Repair:
    """Times of one month's source rows [start, stop) move by ``shift_ns`` if the first and the last are as expected."""

    month: str
    start: int
    stop: int
    shift_ns: int
    expected_first_ns: int
    expected_last_ns: int


def repair(axis: DataFrame, repairs: list[Repair], time: str = "t", src: str = "src", month: str = "month") -> tuple[DataFrame, int]:
    """The axis (month, src within the month, t) with registered repairs, and how many rows moved."""
    if not repairs:
        return axis, 0
    spark = axis.sparkSession
    rules = spark.createDataFrame([(r.month, r.start, r.stop, r.shift_ns, r.expected_first_ns, r.expected_last_ns) for r in repairs], "rule_month string, start long, stop long, shift_ns long, first_ns long, last_ns long")
    hit = (F.col(month) == F.col("rule_month")) & (F.col(src) >= F.col("start")) & (F.col(src) < F.col("stop"))
    joined = axis.join(F.broadcast(rules), hit, "left")
    found = (
        joined.where("rule_month is not null").groupBy("rule_month", "start")
        .agg(F.count(F.lit(1)).alias("n"), F.min_by(time, src).alias("a"), F.max_by(time, src).alias("b"), F.first("stop").alias("stop"), F.first("first_ns").alias("first_ns"), F.first("last_ns").alias("last_ns"))
        .collect()
    )
    require(len(found) == len(repairs), "a repair has no rows")
    for r in found:
        require(r["n"] == r["stop"] - r["start"], f"{r['rule_month']}: the repair's rows are incomplete")
        require(r["a"] == r["first_ns"] and r["b"] == r["last_ns"], f"{r['rule_month']}: times are not those that were registered")
    out = joined.withColumn(time, F.col(time) + F.coalesce("shift_ns", F.lit(0))).select(*axis.columns)
    falls = out.select((F.col(time) - F.lag(time).over(W.partitionBy(month).orderBy(src))).alias("d")).where("d <= 0")
    require(falls.isEmpty(), "repaired times do not rise")
    return out, sum(r["n"] for r in found)
