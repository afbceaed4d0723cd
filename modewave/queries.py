"""The registered queries of the mode engine and the SQL that each is held against.

Solver results are not expressible in SQL; their queries return invariants (traces, energies, closed forms) that
SQL derives independently from the data.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ContractError
from .functions import scalar
from .operators import blocks, features, gapfill, geometry, masks, modes, regrid, solvers, standardize, stats, timeaxis
from .plans import column, products, surface
from .plans import cube as C
from .sources import arrays, runs
from .sources.config import column_config, surface_config

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, as sums of floats depend on their order; adding 0 turns -0 into 0. Decimal inputs sit on rounding ties: where they
    do, both sides first add a nudge."""
    return F.round(c, digits) + F.lit(0.0)


# ---------------------------------------------------------------- the cube

CUBE = """
cube AS (
  SELECT year(l_shipdate) * 12 + month(l_shipdate) - 1 AS t, s_nationkey AS cell,
         avg(l_quantity) AS u, avg(l_extendedprice) / 1000 AS v, avg(l_discount) AS eta
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
cells AS (SELECT s_nationkey AS cell, count(*)::DOUBLE AS area FROM supplier GROUP BY ALL),
frac AS (SELECT cell, count(*) / (SELECT count(DISTINCT t) FROM cube)::DOUBLE AS fraction FROM cube GROUP BY ALL),
kept AS (SELECT cell FROM frac WHERE fraction >= 0.95),
own AS (SELECT * FROM cube WHERE cell IN (SELECT cell FROM kept)),
full_t AS (SELECT t FROM own GROUP BY t HAVING count(*) = (SELECT count(*) FROM kept)),
prep AS (SELECT * FROM own WHERE t IN (SELECT t FROM full_t)),
long AS (
  SELECT t, cell, 'u' AS component, u AS x FROM prep UNION ALL SELECT t, cell, 'v', v FROM prep UNION ALL SELECT t, cell, 'eta', eta FROM prep),
anom AS (
  SELECT t, cell, component, avg(x) OVER (PARTITION BY cell, component) AS mean, x - avg(x) OVER (PARTITION BY cell, component) AS anomaly,
         sqrt(area) AS weight, CASE WHEN component = 'eta' THEN 1 ELSE 0 END AS feature_group
  FROM long JOIN cells USING (cell)),
rms AS (
  SELECT feature_group, sqrt(sum(anomaly * anomaly * weight * weight) / sum(weight * weight)) AS rms FROM anom GROUP BY ALL),
x AS (SELECT anom.*, weight / rms AS scale, anomaly * weight / rms AS x FROM anom JOIN rms USING (feature_group))
"""


def sql(select: str) -> str:
    return f"WITH {CUBE} {select}"


@query(sql("SELECT t, cell, round(u + 1.3e-8, 6) + 0.0 AS u, round(v + 1.3e-8, 6) + 0.0 AS v, round(eta + 1.3e-8, 6) + 0.0 AS eta FROM cube"))
def cube_month_nation(spark, sf_dir):
    return C.cube(spark, sf_dir).select("t", F.col("cell"), *(r(F.col(c) + 1.3e-8).alias(c) for c in ("u", "v", "eta")))


@query(sql("SELECT cell, round(fraction, 9) AS fraction, fraction >= 0.95 AS kept FROM frac"))
def cell_valid_fraction(spark, sf_dir):
    return C.fractions(spark, sf_dir).select("cell", F.round("fraction", 9).alias("fraction"), (F.col("fraction") >= 0.95).alias("kept"))


@query(sql("SELECT DISTINCT t FROM prep"))
def complete_time_filter(spark, sf_dir):
    return C.prepared(spark, sf_dir).select("t").distinct()


@query(sql("SELECT cell, component, round(avg(x) + 1.3e-8, 6) + 0.0 AS mean FROM long GROUP BY ALL"))
def feature_mean(spark, sf_dir):
    return standardize.feature_means(C.long(spark, sf_dir), "x", "cell", "component").select("cell", "component", r(F.col("mean") + 1.3e-8).alias("mean"))


@query(sql("SELECT feature_group, round(rms, 6) AS rms FROM rms"))
def group_rms(spark, sf_dir):
    return standardize.group_scales(C.anomaly(spark, sf_dir)).select("feature_group", F.round("rms", 6).alias("rms"))


@query(sql("""SELECT round(sqrt(sum(CASE WHEN component <> 'eta' THEN weight * weight * anomaly * anomaly END) / sum(CASE WHEN component <> 'eta' THEN weight * weight END)), 6) AS velocity_rms,
round(sqrt(sum(CASE WHEN component = 'eta' THEN weight * weight * anomaly * anomaly END) / sum(CASE WHEN component = 'eta' THEN weight * weight END)), 6) AS eta_rms FROM anom"""))
def surface_rms(spark, sf_dir):
    wide = C.anomaly(spark, sf_dir).groupBy("t", "cell", "area").pivot("component", ["u", "v", "eta"]).agg(F.first("anomaly"))
    out = standardize.surface_scales(wide.select("area", F.col("u").alias("au"), F.col("v").alias("av"), F.col("eta").alias("aeta")))
    return out.select(F.round("velocity_rms", 6).alias("velocity_rms"), F.round("eta_rms", 6).alias("eta_rms"))


@query(sql("SELECT t, cell, component, round(anomaly, 6) + 0.0 AS anomaly, round(x, 6) + 0.0 AS x FROM x"))
def anomaly_scaled(spark, sf_dir):
    return C.scaled(spark, sf_dir).select("t", "cell", "component", r("anomaly").alias("anomaly"), r("x").alias("x"))


@query(sql("""SELECT a.component AS component_i, a.cell AS cell_i, b.component AS component_j, b.cell AS cell_j, round(sum(a.x * b.x) / ((SELECT count(DISTINCT t) FROM prep) - 1), 6) + 0.0 AS cov
FROM x a JOIN x b ON a.t = b.t AND (a.component, a.cell) <= (b.component, b.cell) GROUP BY ALL"""))
def covariance_upper(spark, sf_dir):
    """Covariances of all features, within and across components."""
    own = C.scaled(spark, sf_dir).withColumn("f", F.struct("component", "cell"))
    out = standardize.covariance(own, "x", "t", "f")
    return out.select(F.col("i.component").alias("component_i"), F.col("i.cell").alias("cell_i"), F.col("j.component").alias("component_j"), F.col("j.cell").alias("cell_j"), r("cov").alias("cov"))


@query(sql("SELECT round(sum(x * x), 5) AS total, round(sum(x * x), 5) AS blocks FROM x"))
def total_sum_squares(spark, sf_dir):
    rows = C.scaled(spark, sf_dir)
    index, n = C.with_ids(rows), rows.select("component", "cell").distinct().count()
    times = sorted(x[0] for x in rows.select("t").distinct().collect())
    m = blocks.to_blocks(index.join(F.broadcast(spark.createDataFrame(list(enumerate(times)), "t_idx long, t long")), "t"), n, len(times), 32)
    return _one(spark, total=round(float(standardize.total_sum_squares(rows, "x")), 5), blocks=round(blocks.frobenius2(m), 5))


# ---------------------------------------------------------------- solvers, by invariants


def _one(spark, **values) -> DataFrame:
    kind = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    values = {k: v.item() if hasattr(v, "item") else v for k, v in values.items()}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kind[type(v)]}" for k, v in values.items()))


def leading_modes(spark, sf_dir) -> DataFrame:
    """The flagship: spectrum of the cube's leading joint modes."""
    return modes.spectrum_table(spark, C.solve(spark, sf_dir, 20).svd)


QUERIES["leading_modes"] = leading_modes


#: The sums of the second, fourth and sixth powers of the singular values, from the Gram matrix g (i, j, v) of the features.
MOMENTS = """(SELECT sum(v) FROM g WHERE i = j) AS s2, (SELECT sum(v * v) FROM g) AS s4,
(SELECT sum(a.v * b.v * c.v) FROM g a JOIN g b ON a.j = b.i JOIN g c ON b.j = c.i AND c.j = a.i) AS s6"""
GRAM = "f AS (SELECT t, dense_rank() OVER (ORDER BY component, cell) AS f, x FROM x), g AS (SELECT a.f AS i, b.f AS j, sum(a.x * b.x) AS v FROM f a JOIN f b USING (t) GROUP BY ALL)"


def _moments(s: np.ndarray) -> dict[str, float]:
    return {f"s{k}": float((s**k).sum()) for k in (2, 4, 6)}


def _digits(df: DataFrame, *cols: str, digits: int = 7) -> DataFrame:
    """Large numbers to so many significant digits: as a mantissa and an exponent, which SQL forms in the same way."""
    return df.withColumns({c: F.round(F.col(c) / F.pow(F.lit(10.0), F.floor(F.log10(c))), digits) for c in cols}).select("*")


def _digits_sql(c: str, digits: int = 7) -> str:
    return f"round({c} / power(10.0, floor(log10({c}))), {digits}) AS {c}"


@query(f"WITH {CUBE}, {GRAM}, m AS (SELECT {MOMENTS}) SELECT round(s2 / ((SELECT count(DISTINCT t) FROM prep) - 1), 5) AS trace, {_digits_sql('s2')}, {_digits_sql('s4')}, {_digits_sql('s6')}, 1.0::DOUBLE AS sum_ev FROM m")
def spectrum_invariants(spark, sf_dir):
    """The whole spectrum by its power sums, which the data give without a decomposition."""
    s = C.solve(spark, sf_dir, 10_000).svd
    one = _one(spark, trace=round(float(s.total / (s.n_times - 1)), 5), sum_ev=round(float(s.all_ev.sum()), 9), **_moments(s.s))
    return _digits(one, "s2", "s4", "s6")


@query(sql("SELECT t, round(sum(x * x), 5) + 0.0 AS energy FROM x GROUP BY t"))
def pc_energy(spark, sf_dir):
    """All modes' squared coefficients at each time: the energy of the state."""
    got = C.solve(spark, sf_dir, 10_000)
    return modes.coefficients_table(spark, got.svd.pc, got.axis).groupBy("t").agg(r(F.sum(F.col("value") * F.col("value")), 5).alias("energy"))


@query(sql("SELECT t, cell, component, round(anomaly + mean + 1.3e-8, 5) + 0.0 AS value FROM anom"))
def full_rank_reconstruction(spark, sf_dir):
    """Mean plus all modes gives the data back."""
    got = C.solve(spark, sf_dir, 10_000)
    phys = modes.physical(modes.loadings_table(spark, got.svd.u), got.features)
    back = modes.reconstruct(got.features, phys, modes.coefficients_table(spark, got.svd.pc, got.axis), 10_000)
    return back.join(got.features.select("feature_id", "cell", "component"), "feature_id").select("t", "cell", "component", r(F.col("value") + 1.3e-8, 5).alias("value"))


#: Each cell's two velocity components apart from all others: a matrix whose singular values have a closed form, two for each cell.
PAIRS = """p AS (SELECT a.cell, count(*) AS n, sum(a.x * a.x) AS su, sum(b.x * b.x) AS sv, sum(a.x * b.x) AS suv FROM x a JOIN x b ON a.t = b.t AND a.cell = b.cell AND a.component = 'u' AND b.component = 'v' GROUP BY ALL),
e AS (SELECT (su + sv) / 2 + sqrt((su - sv) * (su - sv) / 4 + suv * suv) AS l FROM p UNION ALL SELECT (su + sv) / 2 - sqrt((su - sv) * (su - sv) / 4 + suv * suv) FROM p),
o AS (SELECT (row_number() OVER (ORDER BY l DESC))::INTEGER AS mode, l, sum(l) OVER () AS total, (SELECT sum(n) FROM p) AS times FROM e)"""


def _pairs(spark, sf_dir) -> tuple[DataFrame, blocks.BlockMatrix, np.ndarray]:
    """(features, matrix, axis): two features for each cell, at times of the cell's own; zero elsewhere."""
    own = C.scaled(spark, sf_dir).where("component <> 'eta'").select("cell", "t", "component", "x")
    cells = sorted(x[0] for x in own.select("cell").distinct().collect())
    times = sorted(x[0] for x in own.select("t").distinct().collect())
    at = spark.createDataFrame([(c, i) for i, c in enumerate(cells)], "cell long, i long")
    order = spark.createDataFrame(list(enumerate(times)), "k long, t long")
    placed = own.withColumn("cell", F.col("cell").cast("long")).join(at, "cell").join(order, "t").select((2 * F.col("i") + (F.col("component") == "v").cast("long")).alias("feature_id"), (F.col("i") * len(times) + F.col("k")).alias("t_idx"), "x")
    n, m = 2 * len(cells), len(cells) * len(times)
    grid = spark.range(n).withColumnRenamed("id", "feature_id").crossJoin(spark.range(m).withColumnRenamed("id", "t_idx"))
    whole = grid.join(placed, ["feature_id", "t_idx"], "left").na.fill(0.0, ["x"])
    feats = spark.createDataFrame([(i, 0.0, 1.0) for i in range(n)], "feature_id long, mean double, scale double")
    return feats, blocks.kept(blocks.to_blocks(whole, n, m, 256)), np.arange(m, dtype=np.int64)


@query(f"WITH {CUBE}, {PAIRS}, k AS (SELECT unnest([1, 5, 20])::INTEGER AS modes) SELECT modes, round(coalesce((SELECT sum(l) FROM o WHERE mode > modes), 0), 4) AS left_over, round(sqrt(coalesce((SELECT sum(l) / any_value(total) FROM o WHERE mode > modes), 0)), 6) AS relative FROM k")
def rank_r_reconstruction(spark, sf_dir):
    """What a reconstruction from the first modes leaves over, by taking it from the data: the rest of the closed-form spectrum."""
    feats, m, axis = _pairs(spark, sf_dir)
    data = spark.createDataFrame([(int(f), int(t), float(x)) for (f, t), x in np.ndenumerate(blocks.collected(m))], "feature_id long, t long, x double")
    rows = []
    for k in (1, 5, 20):
        s = solvers.by_covariance(m, k)
        back = modes.reconstruct(feats, modes.physical(modes.loadings_table(spark, s.u), feats), modes.coefficients_table(spark, s.pc, axis), k)
        left = back.join(data, ["feature_id", "t"]).agg(F.sum(F.pow(F.col("x") - F.col("value"), 2))).first()[0]
        rows.append((k, round(float(left), 4), round(s.retained_error, 6)))
    return spark.createDataFrame(rows, "modes int, left_over double, relative double")


@query(f"WITH {CUBE}, {PAIRS} SELECT mode, round(l / (times - 1), 6) AS pattern, 1.0::DOUBLE AS deviation FROM o WHERE mode <= 20")
def standardised_coefficients(spark, sf_dir):
    """Coefficients with unit deviation, and regression patterns that carry a mode's variance: the closed-form spectrum."""
    feats, m, axis = _pairs(spark, sf_dir)
    s = solvers.by_covariance(m, 20)
    pcs = modes.coefficients_table(spark, s.pc, axis)
    patterns = modes.regression(modes.physical(modes.loadings_table(spark, s.u), feats), pcs).groupBy("mode").agg(F.round(F.sum(F.pow("regression", F.lit(2.0))), 6).alias("pattern"))
    return patterns.join(pcs.groupBy("mode").agg(F.round(F.stddev_samp("standardised"), 9).alias("deviation")), "mode").select("mode", "pattern", "deviation")


@query(f"WITH {CUBE}, {PAIRS} SELECT mode, round(l / (times - 1), 5) AS variance FROM o")
def two_component_axes(spark, sf_dir):
    """Variance ellipses of all cells in one decomposition: major and minor axes have a closed form."""
    _, m, _ = _pairs(spark, sf_dir)
    s = solvers.by_covariance(m, m.n_features)
    return spark.createDataFrame([(i + 1, round(float(x), 5)) for i, x in enumerate(s.s**2 / (m.n_times - 1))], "mode int, variance double")


@query(sql("SELECT component, (dense_rank() OVER (ORDER BY CASE component WHEN 'u' THEN 0 WHEN 'v' THEN 1 ELSE 2 END, cell) - 1)::BIGINT AS feature_id, cell FROM (SELECT DISTINCT component, cell FROM long)"))
def feature_map(spark, sf_dir):
    return C.with_ids(C.long(spark, sf_dir)).select("component", "feature_id", "cell").distinct()


@query(sql("""SELECT component, cell, (dense_rank() OVER (ORDER BY CASE component WHEN 'eta' THEN 0 WHEN 'u' THEN 1 ELSE 2 END, cell) - 1)::BIGINT AS host, round(sum(x * x) + 1.3e-8, 4) AS energy FROM x GROUP BY component, cell"""))
def transpose_permutation(spark, sf_dir):
    """Factors in the host's order of features: left vectors times singular values hold each feature's sum of squares."""
    got = C.solve(spark, sf_dir, 10_000)
    feats = got.features.select("feature_id", "component", F.lit(0).alias("row"), F.col("cell").alias("col"), "mean", "scale")
    host = features.feature_map(feats.select("component", "row", "col"), features.COLUMN_ORDER).withColumnRenamed("feature_id", "host")
    moved = modes.physical(modes.loadings_table(spark, got.svd.u), got.features).join(feats, "feature_id").join(host, ["component", "row", "col"]).drop("feature_id").withColumnRenamed("host", "feature_id")
    spectrum = modes.spectrum_table(spark, got.svd)
    left, _ = modes.host_layout(moved.select("mode", "feature_id", "loading", "physical"), modes.coefficients_table(spark, got.svd.pc, got.axis), spectrum)
    energy = left.join(spectrum.select("mode", "sigma"), "mode").groupBy(F.col("feature_id").alias("host")).agg(F.sum(F.pow(F.col("loading") * F.col("sigma"), 2)).alias("energy"))
    return energy.join(host, "host").select("component", F.col("col").alias("cell"), "host", F.round(F.col("energy") + 1.3e-8, 4).alias("energy"))


EMBEDDED = """v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS f FROM embeddings), g AS (SELECT a.f AS i, b.f AS j, sum(a.x * b.x) AS v FROM v a JOIN v b USING (vec_id) GROUP BY ALL)"""


def _vectors(spark, sf_dir) -> tuple[blocks.BlockMatrix, int]:
    e = C.read(spark, sf_dir, "embeddings")
    width = len(e.first()["embedding"])
    return blocks.kept(blocks.from_rows(e, width, "embedding", "vec_id")), width


def _by_solver(spark, found: dict[str, solvers.Svd]) -> DataFrame:
    rows = [(n, s.n_times, len(s.s), *(_moments(s.s)[f"s{k}"] for k in (2, 4))) for n, s in found.items()]
    return _digits(spark.createDataFrame(rows, "solver string, vectors long, modes long, s2 double, s4 double"), "s2", "s4")


def _solver_sql(*names: str) -> str:
    m = f"SELECT (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(DISTINCT i) FROM g) AS modes, {MOMENTS}"
    return f"WITH {EMBEDDED}, m AS ({m}) SELECT solver, vectors, modes, {_digits_sql('s2')}, {_digits_sql('s4')} FROM m, (VALUES {', '.join(f"('{n}')" for n in names)}) n(solver)"


@query(_solver_sql("dense"))
def direct_svd_embeddings(spark, sf_dir):
    """The solver that the matrix' size calls for, on all vectors: its spectrum by power sums."""
    m, width = _vectors(spark, sf_dir)
    s = solvers.direct(m, width)
    return _by_solver(spark, {s.solver: s})


@query(_solver_sql("block_krylov", "qr_tree"))
def krylov_svd_embeddings(spark, sf_dir):
    """The Krylov and QR-tree solvers, on all vectors: their whole spectra by power sums."""
    m, width = _vectors(spark, sf_dir)
    return _by_solver(spark, {"block_krylov": solvers.krylov(m, width), "qr_tree": solvers.qr_tree(m, width)})


# ---------------------------------------------------------------- time axes, on events

HOUR_NS = "epoch_us(date_trunc('hour', ts)) * 1000"


def _axis(spark, sf_dir) -> DataFrame:
    e = C.read(spark, sf_dir, "events")
    return e.select(F.col("event_id").cast("long").alias("src"), scalar.timestamp_to_ns(F.date_trunc("hour", "ts")).alias("t"))


@query(f"SELECT {HOUR_NS} AS t, max(event_id)::BIGINT AS src FROM events GROUP BY 1")
def time_canonicalize(spark, sf_dir):
    return timeaxis.canonicalize(_axis(spark, sf_dir))[0].select("t", "src")


@query(f"""SELECT (SELECT count(*) FROM events) AS rows_in, count(DISTINCT t) AS rows_out, count(*) FILTER (a <> b) AS reordered, count(*) - count(DISTINCT t) AS dropped
FROM (SELECT t, row_number() OVER (ORDER BY t, event_id) AS a, row_number() OVER (ORDER BY event_id) AS b FROM (SELECT event_id, {HOUR_NS} AS t FROM events))""")
def canonicalize_report(spark, sf_dir):
    c = timeaxis.canonicalize(_axis(spark, sf_dir))[1]
    return _one(spark, rows_in=c.rows_in, rows_out=c.rows_out, reordered=c.reordered, dropped=c.dropped)


@query(f"""SELECT {HOUR_NS} AS t, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1""")
def prefer_last_records(spark, sf_dir):
    e = C.read(spark, sf_dir, "events").select(F.col("event_id").alias("src"), scalar.timestamp_to_ns(F.date_trunc("hour", "ts")).alias("t"), "event_type", "value")
    return timeaxis.prefer_last(e, "t", "src").select("t", "event_type", F.round("value", 6).alias("value"))


@query(f"""WITH a AS (SELECT DISTINCT {HOUR_NS} AS t FROM events), g AS (SELECT (t - lag(t) OVER (ORDER BY t)) / 3.6e12 AS h FROM a)
SELECT median(h) AS median_hours, max(h) AS maximum_hours, count(*) FILTER (h > 1.01) AS breaks FROM g""")
def cadence_stats(spark, sf_dir):
    return timeaxis.cadence_stats(timeaxis.canonicalize(_axis(spark, sf_dir))[0], 1.0)


@query(f"""WITH a AS (SELECT DISTINCT event_type, {HOUR_NS} AS t FROM events),
b AS (SELECT *, CASE WHEN (t - lag(t) OVER (PARTITION BY event_type ORDER BY t)) / 3.6e12 > 1.5 THEN 1 ELSE 0 END AS n FROM a),
c AS (SELECT event_type, t, sum(n) OVER (PARTITION BY event_type ORDER BY t) AS segment FROM b)
SELECT event_type, segment::BIGINT AS segment, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM c GROUP BY ALL""")
def gap_segments(spark, sf_dir):
    e = C.read(spark, sf_dir, "events").select("event_type", scalar.timestamp_to_ns(F.date_trunc("hour", "ts")).alias("t")).distinct()
    return timeaxis.segments(e, 1.0, "t", 1.5, "event_type").groupBy("event_type", "segment").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH a AS (SELECT strftime(ts, '%Y%m') AS month, event_id, {HOUR_NS} AS t FROM events),
h AS (SELECT month, t, row_number() OVER (PARTITION BY month ORDER BY t) - 1 AS src FROM (SELECT DISTINCT month, t FROM a)),
m AS (SELECT max(month) AS month FROM h)
SELECT h.month, src::BIGINT AS src, CASE WHEN h.month = m.month AND src < 24 THEN t - 86400000000000 ELSE t END AS t FROM h, m""")
def time_repair(spark, sf_dir):
    """The first day of the last month moves by a day, as a registered repair whose bounds are checked."""
    e = C.read(spark, sf_dir, "events").select(F.date_format("ts", "yyyyMM").alias("month"), scalar.timestamp_to_ns(F.date_trunc("hour", "ts")).alias("t")).distinct()
    axis = e.selectExpr("month", "row_number() over (partition by month order by t) - 1 as src", "t").withColumn("src", F.col("src").cast("long"))
    last = axis.agg(F.max("month")).first()[0]
    day = {x["src"]: x["t"] for x in axis.where(F.col("month") == last).where("src < 24").collect()}
    rule = timeaxis.Repair(last, 0, len(day), -scalar.NS_PER_DAY, day[0], day[len(day) - 1])
    return timeaxis.repair(axis, [rule])[0].select("month", "src", "t")


GAPS = f"""
h AS (SELECT event_type, {HOUR_NS} AS t, avg(value) AS value FROM events GROUP BY ALL),
axis AS (SELECT DISTINCT t FROM h), types AS (SELECT DISTINCT event_type FROM h),
d AS (SELECT event_type, t, value, row_number() OVER (PARTITION BY event_type ORDER BY t) AS i FROM axis CROSS JOIN types LEFT JOIN h USING (event_type, t)),
b AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER p AS i0, last_value(value IGNORE NULLS) OVER p AS v0,
  first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER f AS i1, first_value(value IGNORE NULLS) OVER f AS v1 FROM d
  WINDOW p AS (PARTITION BY event_type ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         f AS (PARTITION BY event_type ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
filled AS (SELECT event_type, t, value IS NULL AND i0 IS NOT NULL AND i1 IS NOT NULL AND i1 - i0 - 1 <= {{k}} AS imputed, value, i, i0, i1, v0, v1 FROM b)
SELECT event_type, t, imputed, round(CASE WHEN imputed THEN v0 + (i - i0) / (i1 - i0)::DOUBLE * (v1 - v0) ELSE value END, 6) + 0.0 AS value FROM filled"""


def _filled(spark, sf_dir, k: int) -> DataFrame:
    h = C.read(spark, sf_dir, "events").groupBy("event_type", scalar.timestamp_to_ns(F.date_trunc("hour", "ts")).alias("t")).agg(F.avg("value").alias("value"))
    full = gapfill.dense(h, h.select("t").distinct(), h.select("event_type").distinct())
    return gapfill.fill_short_gaps(full, ("value",), k, ("event_type",))


@query("WITH " + GAPS.format(k=2))
def short_gap_fill(spark, sf_dir):
    return _filled(spark, sf_dir, 2).select("event_type", "t", "imputed", r("value").alias("value"))


@query("WITH " + GAPS.format(k=1))
def short_gap_fill_one(spark, sf_dir):
    return _filled(spark, sf_dir, 1).select("event_type", "t", "imputed", r("value").alias("value"))


@query("SELECT event_type, count(*) FILTER (imputed) AS imputed, count(*) FILTER (value IS NULL) AS missing FROM (WITH " + GAPS.format(k=1) + ") GROUP BY ALL")
def imputed_count(spark, sf_dir):
    return _filled(spark, sf_dir, 1).groupBy("event_type").agg(F.count_if("imputed").alias("imputed"), F.count_if(F.col("value").isNull()).alias("missing"))


@query("SELECT user_id % 10 AS mode, epoch_us(ts) // 86400000000 AS day, round(avg(value), 6) + 0.0 AS mean, count(*) AS n FROM events GROUP BY ALL")
def daily_mean(spark, sf_dir):
    e = C.read(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("mode"), scalar.timestamp_to_ns("ts").alias("t"), "value")
    return stats.daily_means(e).select("mode", "day", r("mean").alias("mean"), "n")


@query("""WITH b AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 21600000000 THEN 0 ELSE 1 END AS n FROM events),
c AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM b)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM c GROUP BY user_id, s""")
def session_segments(spark, sf_dir):
    e = C.read(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")).drop("w")


@query("""SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y%m') AS month_id, epoch_us(ts) * 1000 AS ns, epoch_us(ts) // 86400000000 AS day,
regexp_replace(event_type || ' x.1', '[^a-zA-Z0-9_-]', '_', 'g') AS label, sha256(event_type) AS digest FROM events""")
def scalar_times_and_labels(spark, sf_dir):
    e = C.read(spark, sf_dir, "events").withColumn("ns", scalar.timestamp_to_ns("ts"))
    return e.select(
        "event_id", scalar.iso_utc("ns").alias("iso"), scalar.month_id(F.year("ts"), F.month("ts")).alias("month_id"), "ns", scalar.day_index("ns").alias("day"),
        scalar.safe_label(F.concat("event_type", F.lit(" x.1"))).alias("label"), F.sha2("event_type", 256).alias("digest"),
    )


# ---------------------------------------------------------------- vertical and horizontal interpolation

BRACKET = """
a AS (SELECT l_orderkey AS col, l_linenumber AS layer, -l_quantity AS z, l_extendedprice / 1000 AS u, l_discount AS v FROM lineitem),
lo AS (SELECT col, z, u, v FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY z DESC, layer, u DESC, v DESC) AS n FROM a WHERE z <= {z}) WHERE n = 1),
hi AS (SELECT col, z, u, v FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY z, layer, u, v) AS n FROM a WHERE z >= {z}) WHERE n = 1)
"""


@query("WITH " + BRACKET.format(z=-25.0) + """SELECT lo.col, round(CASE WHEN hi.z = lo.z THEN lo.u ELSE lo.u + (-25.0 - lo.z) / (hi.z - lo.z) * (hi.u - lo.u) END + 1.3e-8, 6) + 0.0 AS u,
round(CASE WHEN hi.z = lo.z THEN lo.v ELSE lo.v + (-25.0 - lo.z) / (hi.z - lo.z) * (hi.v - lo.v) END + 1.3e-8, 6) + 0.0 AS v, round(hi.z - lo.z, 6) + 0.0 AS span FROM lo JOIN hi USING (col)""")
def vertical_bracket(spark, sf_dir):
    """Line items as layers of their order. Line numbers repeat in these data, so values break ties."""
    a = C.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("col"), F.col("l_linenumber").alias("layer"), (-F.col("l_quantity")).alias("z"), (F.col("l_extendedprice") / 1000).alias("u"), F.col("l_discount").alias("v"))
    out = regrid.at_depths(a, {"z25": -25.0}, ("col",)).where("span is not null")
    return out.select("col", r(F.col("u") + 1.3e-8).alias("u"), r(F.col("v") + 1.3e-8).alias("v"), r("span").alias("span"))


@query("WITH " + BRACKET.format(z=-10.0) + "SELECT count(*) AS bracketed, (SELECT count(DISTINCT col) FROM a) - count(*) AS without FROM lo JOIN hi USING (col)")
def bracket_coverage(spark, sf_dir):
    a = C.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("col"), F.col("l_linenumber").alias("layer"), (-F.col("l_quantity")).alias("z"), F.col("l_tax").alias("u"), F.col("l_discount").alias("v"))
    out = regrid.at_depths(a, {"z10": -10.0}, ("col",))
    return out.agg(F.count_if(F.col("span").isNotNull()).alias("bracketed"), F.count_if(F.col("span").isNull()).alias("without"))


MESH = """
s AS (SELECT s_nationkey AS row, s_suppkey AS node, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS slot FROM supplier),
mesh AS (SELECT row, node, CASE slot WHEN 1 THEN 0.2 WHEN 2 THEN 0.3 ELSE 0.5 END AS weight FROM s WHERE slot <= 3),
vals AS (SELECT l_suppkey AS node, date_trunc('year', l_shipdate) AS y, avg(l_quantity) AS u FROM lineitem GROUP BY ALL)
"""


def _mesh(spark, sf_dir) -> DataFrame:
    s = C.read(spark, sf_dir, "supplier").selectExpr("s_nationkey as row", "0 as col", "s_suppkey as node", "row_number() over (partition by s_nationkey order by s_suppkey) as slot")
    return s.where("slot <= 3").withColumn("weight", F.expr("case slot when 1 then 0.2D when 2 then 0.3D else 0.5D end"))


@query("WITH " + MESH + "SELECT row, year(y)::INTEGER AS y, round(CASE WHEN count(u) = 3 THEN sum(weight * u) END, 6) + 0.0 AS u FROM mesh JOIN vals USING (node) GROUP BY ALL")
def barycentric(spark, sf_dir):
    vals = C.read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("node"), F.year("l_shipdate").alias("y")).agg(F.avg("l_quantity").alias("u"))
    mesh = _mesh(spark, sf_dir)
    return regrid.barycentric(regrid.needed_nodes(vals, mesh), mesh, ("y",), ("u",)).select("row", "y", r("u").alias("u"))


@query("WITH " + MESH + "SELECT row FROM mesh GROUP BY row HAVING count(*) = 3")
def mesh_support(spark, sf_dir):
    return masks.supported_cells(_mesh(spark, sf_dir)).select("row")


@query("WITH k AS (SELECT DISTINCT l_suppkey AS x FROM lineitem WHERE l_quantity > 49) SELECT count(*) AS runs FROM k WHERE x - 1 NOT IN (SELECT x FROM k)")
def node_runs(spark, sf_dir):
    """Runs of consecutive numbers among suppliers of large quantities: the condition makes the gaps."""
    k = C.read(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_suppkey")
    return _one(spark, runs=regrid.island_count(k, "l_suppkey"))


# ---------------------------------------------------------------- masks, boxes, features

GRID = "grid AS (SELECT (n_nationkey // 5)::BIGINT AS row, n_nationkey % 5 AS col, 120 + 0.01 * (n_nationkey % 5) AS lon, 22 + 0.01 * (n_nationkey // 5) AS lat, 10.0 * (n_nationkey % 7) AS bathymetry, n_nationkey FROM nation)"


def _grid(spark, sf_dir) -> DataFrame:
    n = C.read(spark, sf_dir, "nation")
    row, col = F.floor(F.col("n_nationkey") / 5).cast("long"), F.col("n_nationkey") % 5
    return n.select(row.alias("row"), col.alias("col"), (F.lit(120.0) + 0.01 * col).alias("lon"), (F.lit(22.0) + 0.01 * row).alias("lat"), (10.0 * (F.col("n_nationkey") % 7)).alias("bathymetry"), F.col("n_nationkey").alias("cell"))


@query(f"WITH {GRID} SELECT row, col FROM grid WHERE lon BETWEEN 120.01 - 1e-10 AND 120.03 + 1e-10 AND lat BETWEEN 22.0 - 1e-10 AND 22.02 + 1e-10")
def bbox_filter(spark, sf_dir):
    return masks.geometry(_grid(spark, sf_dir), (120.01, 120.03, 22.0, 22.02)).where("inside").select("row", "col")


@query(f"WITH {GRID}, a AS (SELECT DISTINCT col, lon FROM grid) SELECT (max(col) FILTER (lon <= 120.015))::BIGINT AS start, (min(col) FILTER (lon >= 120.025) + 1)::BIGINT AS stop FROM a")
def axis_snap(spark, sf_dir):
    a, b = masks.snap_axis(_grid(spark, sf_dir).select("col", "lon").distinct(), "lon", "col", 120.015, 120.025)
    return _one(spark, start=a, stop=b)


@query(f"WITH {GRID} SELECT row, col FROM grid ORDER BY power((lon - 120.018) * cos(radians(22.021)), 2) + power(lat - 22.021, 2), row, col LIMIT 1")
def nearest_cell(spark, sf_dir):
    return masks.nearest(_grid(spark, sf_dir), 120.018, 22.021).select("row", "col")


@query(f"""WITH {GRID}, levels AS (SELECT * FROM (VALUES (0, 0.0), (1, 10.0), (2, 20.0), (3, 30.0), (4, 40.0), (5, 50.0)) v(level, depth))
SELECT level, count(*) AS cells, sum(row * 5 + col)::BIGINT AS total FROM grid, levels WHERE n_nationkey <> 3 AND (level = 0 OR (n_nationkey % 2 = 0 AND bathymetry >= depth)) GROUP BY level""")
def static_candidate(spark, sf_dir):
    levels = spark.createDataFrame([(i, 10.0 * i, 10.0) for i in range(6)], "level int, depth_m double, weight_m double")
    g = _grid(spark, sf_dir).withColumn("inside", F.lit(True)).withColumn("static", F.col("cell") != 3).withColumn("supported", F.col("cell") % 2 == 0)
    return masks.static_candidates(g, levels).groupBy("level").agg(F.count(F.lit(1)).alias("cells"), F.sum(F.col("row") * 5 + F.col("col")).alias("total"))


FRACTIONS = """
months AS (SELECT count(DISTINCT date_trunc('month', l_shipdate)) AS n FROM lineitem),
f AS (SELECT l_linenumber AS level, s_nationkey AS cell, count(DISTINCT CASE WHEN l_discount > 0.02 THEN date_trunc('month', l_shipdate) END) AS nu,
  count(DISTINCT CASE WHEN l_tax > 0.02 THEN date_trunc('month', l_shipdate) END) AS nv FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
"""


def _fractions(spark, sf_dir) -> tuple[DataFrame, int]:
    items = C.read(spark, sf_dir, "lineitem").join(C.read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    month = F.date_trunc("month", "l_shipdate")
    n = items.agg(F.countDistinct(month)).first()[0]
    own = items.groupBy(F.col("l_linenumber").alias("level"), F.col("s_nationkey").alias("col")).agg(F.countDistinct(F.when(F.col("l_discount") > 0.02, month)).alias("u"), F.countDistinct(F.when(F.col("l_tax") > 0.02, month)).alias("v"))
    return features.unpivot(own, ("level", "col"), ("u", "v")).select("component", "level", F.lit(0).alias("row"), "col", (F.col("x") / n).alias("fraction")), n


@query("WITH " + FRACTIONS + "SELECT level, cell, component FROM f, months, (VALUES ('u'), ('v')) c(component) WHERE least(nu, nv) / n::DOUBLE >= 0.3")
def paired_feature_mask(spark, sf_dir):
    return masks.paired_selection(_fractions(spark, sf_dir)[0], 0.3).select("level", F.col("col").alias("cell"), "component")


#: Features of six levels and the surface by region and year; those of one level, region and year are taken out.
PRESENT = """
item AS (SELECT l_linenumber - 1 AS level, n_regionkey AS col, year(l_shipdate) AS t, l_discount, l_tax, l_quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  WHERE NOT (l_linenumber = 1 AND n_regionkey = 0 AND year(l_shipdate) = 1995)),
val AS (SELECT 'u' AS c, level, col, t FROM item WHERE level < 6 AND l_discount >= 0.02 UNION SELECT 'v', level, col, t FROM item WHERE level < 6 AND l_tax >= 0.02 UNION SELECT 'eta', -1, col, t FROM item WHERE l_quantity > 5),
years AS (SELECT count(DISTINCT year(l_shipdate)) AS n FROM lineitem),
frac AS (SELECT c, level, col, count(*) / any_value(n)::DOUBLE AS f FROM val, years GROUP BY c, level, col),
uv AS (SELECT level, col FROM frac WHERE c <> 'eta' GROUP BY ALL HAVING count(*) = 2),
least AS (SELECT unnest([0.5, 1.0]) AS least),
own AS (SELECT least, c, level, col FROM frac JOIN least ON f >= least WHERE c = 'eta' UNION ALL
  SELECT least, a.c, a.level, a.col FROM frac a JOIN uv USING (level, col) JOIN least ON (SELECT min(f) FROM frac b WHERE b.c <> 'eta' AND b.level = a.level AND b.col = a.col) >= least WHERE a.c <> 'eta'),
k AS (SELECT least, count(*) AS features FROM own GROUP BY least),
whole AS (SELECT q.least, count(*) AS times FROM (SELECT own.least, t, count(*) AS m FROM own JOIN val USING (c, level, col) GROUP BY own.least, t) q JOIN k ON k.least = q.least AND q.m = k.features GROUP BY q.least)
"""


@query("WITH " + PRESENT + """SELECT wanted, CASE WHEN a.times / n::DOUBLE >= wanted THEN 'configured_minimum_feature_valid_fraction' ELSE 'complete_feature_fallback_after_time_intersection_loss' END AS policy,
CASE WHEN a.times / n::DOUBLE >= wanted THEN ka.features ELSE kb.features END AS features, CASE WHEN a.times / n::DOUBLE >= wanted THEN a.times ELSE b.times END AS retained
FROM (SELECT unnest([0.5, 1.0])::DOUBLE AS wanted), years, whole a, whole b, k ka, k kb WHERE a.least = 0.5 AND b.least = 1.0 AND ka.least = 0.5 AND kb.least = 1.0""")
def fallback_policy(spark, sf_dir):
    """Selection at the configured share of times; where that keeps too few, only features that are always there."""
    items = C.read(spark, sf_dir, "lineitem").join(C.read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(C.read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    own = items.select((F.col("l_linenumber") - 1).cast("int").alias("level"), F.lit(0).alias("row"), F.col("n_regionkey").cast("int").alias("col"), F.year("l_shipdate").cast("long").alias("t"), "l_discount", "l_tax", "l_quantity")
    times = own.select("t").distinct().select("t", F.lit(0).alias("ordinal"), F.col("t").alias("src"))
    own = own.where(~((F.col("level") == 0) & (F.col("col") == 0) & (F.col("t") == 1995)))
    parts = [own.where("level < 6 and l_discount >= 0.02").withColumn("component", F.lit("u")), own.where("level < 6 and l_tax >= 0.02").withColumn("component", F.lit("v")), own.where("l_quantity > 5").withColumn("component", F.lit("eta")).withColumn("level", F.lit(-1))]
    values = parts[0].unionByName(parts[1]).unionByName(parts[2]).select("t", "component", "level", "row", "col").distinct().withColumn("x", F.lit(1.0)).persist()
    layout = spark.createDataFrame([(c, lv, 0, k, 1.0, int(c == "eta")) for k in range(5) for c, lv in [*((c, i) for c in "uv" for i in range(6)), ("eta", -1)]], "component string, level int, row int, col int, weight double, feature_group int")
    rows = []
    for wanted in (0.5, 1.0):
        config = column_config(_column_config(wanted))
        s = column.select(values, layout, times, config)
        rows.append((wanted, s.policy, s.report["features"], s.report["retained_times"]))
    values.unpersist()
    return spark.createDataFrame(rows, "wanted double, policy string, features long, retained long")


def _column_config(least_times: float) -> dict:
    return {
        "schema_version": "1.0.0", "analysis_kind": "water_column_multivariate_svd", "analysis_label": "regions_v1",
        "domain": {"flow_domain_id": "regions", "bbox_lon_lat": [0, 9, 0, 9], "center_lonlat": [1, 1]}, "input": {"year": 2025, "months": [1], "expected_timestep_hours": 1.0},
        "vertical_sampling": {"fixed_depths_m_below_vertical_datum": [10, 20, 30, 40, 50], "vertical_quadrature_weights_m": [5, 10, 10, 10, 10, 5]},
        "mask_and_missing_data": {"minimum_feature_valid_fraction": 0.5, "minimum_retained_time_fraction": least_times, "minimum_cells_per_velocity_level": 1, "minimum_eta_cells": 1},
        "svd": {"requested_mode_count": 2, "minimum_reported_mode_count": 1}, "solver": {"dense_memory_limit_gib": 1.0}, "figures": {},
    }


@query(f"""WITH {GRID}, e AS (SELECT greatest(119.0, min(lon) - 0.005) AS a, least(120.042, max(lon) + 0.005) AS b, greatest(21.0, min(lat) - 0.005) AS c, least(22.044, max(lat) + 0.005) AS d FROM grid)
SELECT row, col FROM grid, e WHERE row % 2 = 0 AND col % 2 = 0 AND n_nationkey <> 12 AND lon BETWEEN a + 0.06 * (b - a) AND b - 0.06 * (b - a) AND lat BETWEEN c + 0.06 * (d - c) AND d - 0.06 * (d - c)""")
def quiver_thinning(spark, sf_dir):
    """Arrows of every second row and column with finite components, 6 % away from the map's edges."""
    g = _grid(spark, sf_dir).withColumn("u", F.lit(1.0)).withColumn("v", F.expr("case when cell = 12 then double('NaN') else 0.0D end"))
    extent = masks.map_extent(g, (119.0, 120.042, 21.0, 22.044), 0.01, 0.01)
    return masks.thinned(g, stats.quiver_step(5, 5, 3), extent).select("row", "col")


@query(f"WITH {GRID}, z AS (SELECT *, CASE n_nationkey % 4 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN NULL ELSE lon END AS x FROM grid) SELECT row, col, isfinite(x) IS TRUE AS ok, CASE WHEN isfinite(x) THEN x END AS x FROM z")
def finite_ingest(spark, sf_dir):
    g = _grid(spark, sf_dir).withColumn("x", F.expr("case cell % 4 when 0 then double('NaN') when 1 then double('Infinity') when 2 then null else lon end"))
    return g.select("row", "col", scalar.finite("x").alias("ok"), scalar.finite_or_null("x").alias("x"))


# ---------------------------------------------------------------- statistics

AREA_STATS = sql("""SELECT t, round(sum(u * area) / sum(area), 6) + 0.0 AS mean_u, round(sum(v * area) / sum(area), 6) + 0.0 AS mean_v, round(sum(eta * area) / sum(area), 6) + 0.0 AS mean_eta,
round(sum(area) / 1e6, 9) AS area_km2, count(*) AS cells, round(sqrt(power(sum(u * area) / sum(area), 2) + power(sum(v * area) / sum(area), 2)), 6) AS mean_speed FROM cube JOIN cells USING (cell) GROUP BY t""")


@query(AREA_STATS)
def area_weighted_mean(spark, sf_dir):
    own = C.cube(spark, sf_dir).join(C.cells(spark, sf_dir), "cell")
    out = stats.area_stats(own, "t")
    return out.select("t", r("mean_u").alias("mean_u"), r("mean_v").alias("mean_v"), r("mean_eta").alias("mean_eta"), F.round("area_km2", 9).alias("area_km2"), "cells", F.round("mean_speed", 6).alias("mean_speed"))


WIDE = """w AS (SELECT t, cell, max(CASE WHEN component = 'u' THEN anomaly END) AS u, max(CASE WHEN component = 'v' THEN anomaly END) AS v, max(CASE WHEN component = 'eta' THEN anomaly END) AS eta, max(weight * weight) AS area FROM anom GROUP BY ALL)"""


def _wide(spark, sf_dir) -> DataFrame:
    own = C.anomaly(spark, sf_dir).groupBy("t", "cell", "area").pivot("component", ["u", "v", "eta"]).agg(F.first("anomaly"))
    return own.withColumnRenamed("t", "mode")


@query(f"WITH {CUBE}, {WIDE}" + """, m AS (SELECT t AS mode, sum(u * area) / sum(area) AS mu, sum(v * area) / sum(area) AS mv, sqrt(sum((u * u + v * v) * area) / sum(area)) AS rms, quantile_cont(sqrt(u * u + v * v), 0.95) AS q FROM w GROUP BY t)
SELECT mode, round(rms, 6) AS velocity_rms, round(q, 6) AS velocity_q95, round(CASE WHEN rms > 0 THEN sqrt(mu * mu + mv * mv) / rms ELSE 0 END, 6) AS directional_coherence FROM m""")
def mode_velocity_stats(spark, sf_dir):
    out = stats.mode_stats(_wide(spark, sf_dir))
    return out.select("mode", F.round("velocity_rms", 6).alias("velocity_rms"), F.round("velocity_q95", 6).alias("velocity_q95"), F.round("directional_coherence", 6).alias("directional_coherence"))


@query(f"WITH {CUBE}, {WIDE}" + """, s AS (SELECT t AS mode, sqrt(u * u + v * v) AS speed, eta FROM w)
SELECT mode, round(max(abs(eta)), 6) AS eta_limit, round(quantile_cont(CASE WHEN speed > 0 THEN speed END, 0.95), 6) AS q95, round(quantile_cont(speed, 0.98), 6) AS p98 FROM s GROUP BY mode""")
def map_limits(spark, sf_dir):
    out = stats.map_limits(_wide(spark, sf_dir), 1.5)
    return out.select("mode", F.round("eta_limit", 6).alias("eta_limit"), F.round("q95", 6).alias("q95"), F.round("p98", 6).alias("p98"))


@query(f"WITH {CUBE}, {WIDE}" + """, a AS (SELECT t AS mode, cell, (degrees(atan2(v, u)) + 360) % 360 AS d FROM w)
SELECT mode, cell, list_extract(['E', 'NE', 'N', 'NW', 'W', 'SW', 'S', 'SE'], (floor((d + 22.5) / 45)::INTEGER % 8) + 1) AS way FROM a""")
def compass_label(spark, sf_dir):
    return _wide(spark, sf_dir).select("mode", "cell", scalar.compass(F.col("u"), F.col("v")).alias("way"))


@query("""WITH n AS (SELECT c_nationkey AS cell, 100.0 * sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) / count(*) AS p FROM customer GROUP BY ALL)
SELECT cell, CASE WHEN p >= 85 THEN 'two_modes' WHEN p >= 70 THEN 'two_modes_and_minor' ELSE 'spread' END AS kind FROM n""")
def ev_class(spark, sf_dir):
    p = C.read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("cell")).agg((100.0 * F.count_if(F.col("c_acctbal") > 0) / F.count(F.lit(1))).alias("p"))
    return p.select("cell", scalar.ev_class(F.col("p")).alias("kind"))


@query(sql("SELECT round(100.0 * count(DISTINCT t) / 17544, 6) AS coverage, 168::BIGINT AS figures, 2::BIGINT AS step FROM prep"))
def coverage_and_figures(spark, sf_dir):
    n = C.prepared(spark, sf_dir).agg(F.countDistinct("t")).first()[0]
    return _one(spark, coverage=round(stats.coverage(n), 6), figures=stats.figure_count(20), step=stats.quiver_step(24, 32, 16))


# ---------------------------------------------------------------- polygons

RINGS = [
    (1, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]),
    (2, [(-1.0, 1.0), (2.0, 1.0), (2.0, 3.0), (-1.0, 3.0), (-1.0, 1.0)]),
    (3, [(9.0, 9.0), (10.0, 9.0), (10.0, 10.0), (9.0, 9.0)]),
    (4, [(0.0, 0.0), (3.0, 0.0), (0.0, 3.0), (0.0, 0.0)]),
]


@query("SELECT * FROM (VALUES (1, 4.0::DOUBLE), (2, 2.0::DOUBLE), (4, 3.5::DOUBLE)) v(polygon, area)")
def polygon_clip(spark, sf_dir):
    """Areas within the box (0, 2, 0, 2) by hand: a square of 16 leaves 4, a bar leaves 2, half a square of 9 leaves 3.5."""
    rings = spark.createDataFrame([(i, 0, ring) for i, ring in RINGS], "polygon int, ring int, points array<struct<lon:double,lat:double>>")
    return geometry.clip_rings(rings, (0.0, 2.0, 0.0, 2.0)).select("polygon", F.round(geometry.ring_area(), 9).alias("area"))


# ---------------------------------------------------------------- sets


@query("SELECT n_nationkey AS cell FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def missing_keys(spark, sf_dir):
    have = C.read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("cell"))
    return C.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cell")).join(have, "cell", "left_anti")


@query("""WITH a AS (SELECT date_trunc('day', ts) AS d, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY ALL), b AS (SELECT date_trunc('day', ts) AS d, count(*) AS n FROM events WHERE user_id % 2 = 1 GROUP BY ALL)
SELECT count(*) FILTER (a.d IS NULL OR b.d IS NULL) AS unmatched, count(*) FILTER (a.n = b.n) AS equal FROM a FULL JOIN b USING (d)""")
def paired_axes(spark, sf_dir):
    """Two sources' axes meet in a full outer join: unmatched steps show."""
    e = C.read(spark, sf_dir, "events").select(F.date_trunc("day", "ts").alias("d"), "user_id")
    a = e.where("user_id % 2 = 0").groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    b = e.where("user_id % 2 = 1").groupBy("d").agg(F.count(F.lit(1)).alias("m"))
    return a.join(b, "d", "full").agg(F.count_if(F.col("n").isNull() | F.col("m").isNull()).alias("unmatched"), F.count_if(F.col("n") == F.col("m")).alias("equal"))


BY_REGION = """rx AS (SELECT anom.*, n_regionkey AS region FROM anom JOIN nation ON cell = n_nationkey),
rr AS (SELECT region, feature_group, sqrt(sum(anomaly * anomaly * weight * weight) / sum(weight * weight)) AS rms FROM rx GROUP BY ALL),
f AS (SELECT region, t, component, cell, anomaly * weight / rms AS x FROM rx JOIN rr USING (region, feature_group)),
g AS (SELECT region, a.component AS ci, a.cell AS i, b.component AS cj, b.cell AS j, sum(a.x * b.x) AS v FROM f a JOIN f b USING (region, t) GROUP BY ALL),
m AS (SELECT region, count(DISTINCT (ci, i)) AS features, sum(v) FILTER (ci = cj AND i = j) AS s2, sum(v * v) AS s4 FROM g GROUP BY region)"""


@query(f"WITH {CUBE}, {BY_REGION} SELECT region::BIGINT AS region, features, {_digits_sql('s2')}, {_digits_sql('s4')} FROM m")
def mode_regions(spark, sf_dir):
    """Each region's own modes, several at a time: whole spectra by power sums."""
    own = C.anomaly(spark, sf_dir).drop("x").join(C.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cell"), F.col("n_regionkey").alias("region")), "cell").persist()
    times = sorted(x[0] for x in own.select("t").distinct().collect())
    index = spark.createDataFrame(list(enumerate(times)), "t_idx long, t long")

    def one(region: int) -> tuple:
        mine = own.where(F.col("region") == region)
        rows = C.with_ids(standardize.scaled(mine, standardize.group_scales(mine))).join(F.broadcast(index), "t")
        n = mine.select("component", "cell").distinct().count()
        s = solvers.by_covariance(blocks.to_blocks(rows, n, len(times), 32), n)
        return (region, n, *(_moments(s.s)[f"s{k}"] for k in (2, 4)))

    found = products.together([lambda k=k: one(k) for k in sorted(x[0] for x in own.select("region").distinct().collect())], 3)
    own.unpersist()
    return _digits(spark.createDataFrame(found, "region long, features long, s2 double, s4 double"), "s2", "s4")


# ---------------------------------------------------------------- runs on array caches

H = 3_600_000_000_000
FIRST_HOUR = 1_735_689_600_000_000_000  # 2025-01-01
DOMAIN = "nations"
STEPS_A_MONTH = 12
_ROOTS: dict[tuple[str, str], tuple[str, list[int], list[int]]] = {}


def _cache(spark, sf_dir) -> tuple[str, list[int], list[int]]:
    """(root, times, cells): the cube as an array cache, with an hour for each month and a column for each nation; made once a session. A few thousand numbers."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _ROOTS:
        return _ROOTS[key]
    rows = C.cube(spark, sf_dir).toPandas()
    area = {x["cell"]: x["area"] for x in C.cells(spark, sf_dir).collect()}
    times, cells = sorted(int(t) for t in rows["t"].unique()), sorted(int(c) for c in area)
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    root = f"{base.removeprefix('file:').rstrip('/')}/arrays-{uuid.uuid4().hex}"
    grid = Path(root) / DOMAIN / "grid"
    grid.mkdir(parents=True)
    for name, value in (("lon", 120 + 0.01 * np.arange(len(cells))), ("lat", np.array([22.0])), ("cell_area_m2", np.array([[area[c] for c in cells]])), ("mask_static", np.ones((1, len(cells)), bool))):
        np.save(grid / f"{name}.npy", value)
    cube = np.full((3, len(times), 1, len(cells)), np.nan)
    at, col = {t: i for i, t in enumerate(times)}, {c: i for i, c in enumerate(cells)}
    for x in rows.itertuples():
        cube[:, at[x.t], 0, col[x.cell]] = float(x.u), float(x.v), float(x.eta)
    for i, a in enumerate(range(0, len(times), STEPS_A_MONTH)):
        month, part = Path(root) / DOMAIN / "months" / f"2025{i + 1:02d}", slice(a, a + STEPS_A_MONTH)
        month.mkdir(parents=True)
        np.save(month / "time_utc_ns.npy", FIRST_HOUR + H * np.arange(len(times))[part])
        for name, x in zip(("u_surface_mps", "v_surface_mps", "eta_m"), cube[:, part], strict=True):
            np.save(month / f"{name}.npy", x)
        np.save(month / "valid_mask_surface.npy", np.ones(cube[0, part].shape, bool))
        (month / "metadata.json").write_text(json.dumps({"status": "ready", "cache_kind": "standard_month", "month": month.name, "cache_schema_version": "3.0.0", "domain": {"domain_id": DOMAIN}}))
    _ROOTS[key] = root, times, cells
    return _ROOTS[key]


def _months(root: str) -> list[str]:
    return sorted(p.name for p in (Path(root) / DOMAIN / "months").iterdir())


def _config(root: str, cells: list[int]) -> dict:
    return {
        "schema_version": "1.0.0", "analysis_kind": "surface_multivariate_svd", "analysis_label": "nations v1",
        "focus": {"focus_id": "all", "name_zh": "all", "approval_status": "approved", "flow_domain_id": DOMAIN, "bbox_lon_lat": [119.995, 120 + 0.01 * len(cells), 21.9, 22.1], "anchor_lonlat": [120.0, 22.0]},
        "input": {"year": 2025, "months": [int(m[4:]) for m in _months(root)], "required_cache_kinds": ["standard_month"], "required_cache_schema_major": 3, "expected_timestep_hours": 1.0, "maximum_source_gap_hours": None},
        "mask_and_missing_data": {"minimum_static_ocean_cells": 1, "minimum_cell_triplet_valid_fraction": 0.95, "max_consecutive_missing_timesteps_to_interpolate": 0, "minimum_retained_time_fraction": 0.1},
        "svd": {"requested_mode_count": 10_000, "minimum_reported_mode_count": 1}, "figures": {},
    }


def _run(spark, sf_dir) -> tuple[str, list[int], list[int]]:
    """(published run, times, cells) of the array cache."""
    root, times, cells = _cache(spark, sf_dir)
    config = surface_config(_config(root, cells))
    kind, found = runs.selection(spark, f"{root}/out/svd", config.raw)
    return (found if kind == "exact" else surface.run(spark, config, root, f"{root}/out")), times, cells


def _named(df: DataFrame, spark, times: list[int], cells: list[int]) -> DataFrame:
    """Columns and hours back to nations and months."""
    at = spark.createDataFrame([(FIRST_HOUR + H * i, t) for i, t in enumerate(times)], "ns long, month long")
    col = spark.createDataFrame(list(enumerate(cells)), "col long, cell long")
    return df.withColumnRenamed("t", "ns").join(at, "ns").join(col, "col").withColumnRenamed("month", "t")


ROUNDED = ", ".join(f"round({c} + 1.3e-8, 6) + 0.0 AS {c}" for c in ("u", "v", "eta"))


@query(sql(f"SELECT t, cell::BIGINT AS cell, {ROUNDED} FROM cube"))
def array_source(spark, sf_dir):
    """The cube read from an array cache: months' headers, axis and fields."""
    root, times, cells = _cache(spark, sf_dir)
    found = arrays.months(root, DOMAIN, _months(root))
    cube = arrays.surface(spark, root, DOMAIN, found).where("u is not null").join(arrays.axis(spark, root, DOMAIN, found).select("ordinal", "src", "t"), ["ordinal", "src"]).drop("month")
    return _named(cube, spark, times, cells).select("t", "cell", *(r(F.col(c) + 1.3e-8).alias(c) for c in ("u", "v", "eta")))


@query(sql(f"""SELECT t, cell::BIGINT AS cell, {ROUNDED} FROM cube, (SELECT min(t) AS first FROM cube) JOIN (SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS col FROM cells) c USING (cell)
WHERE col BETWEEN 5 AND 8 AND (SELECT count(DISTINCT t) FROM cube b WHERE b.t < cube.t) BETWEEN 12 AND 35""".replace("FROM cube, (SELECT min(t) AS first FROM cube) JOIN", "FROM cube JOIN")))
def table_source(spark, sf_dir):
    """Two months and four columns of the cube, exported to tables and read with both pushed down."""
    root, times, cells = _cache(spark, sf_dir)
    out = f"{root}/tables-{uuid.uuid4().hex}"
    arrays.export(spark, root, DOMAIN, arrays.months(root, DOMAIN, _months(root)), out)
    found = arrays.exported_months(spark, out, DOMAIN, ["202502", "202503"])
    cube, axis = arrays.exported(spark, out, DOMAIN, found, (0, 1, 5, 9))
    own = cube.where("u is not null").join(axis.select("ordinal", "src", "t"), ["ordinal", "src"]).drop("month")
    return _named(own, spark, times, cells).select("t", "cell", *(r(F.col(c) + 1.3e-8).alias(c) for c in ("u", "v", "eta")))


@query("SELECT (row_number() OVER (ORDER BY s_nationkey) - 1)::BIGINT AS col, 0::BIGINT AS row, count(*)::DOUBLE AS area, true AS static FROM supplier GROUP BY s_nationkey")
def grid_source(spark, sf_dir):
    root, _, _ = _cache(spark, sf_dir)
    return arrays.grid(spark, root, DOMAIN).select("col", "row", "area", "static")


@query(f"""WITH {CUBE}, {GRAM}, m AS (SELECT {MOMENTS}) SELECT (SELECT count(*) FROM kept) AS cells, (SELECT count(DISTINCT t) FROM cube) AS times, (SELECT count(*) FROM full_t) AS retained,
(SELECT round(rms, 6) FROM rms WHERE feature_group = 0) AS velocity_rms, (SELECT round(rms, 6) FROM rms WHERE feature_group = 1) AS eta_rms, {_digits_sql('s2')}, {_digits_sql('s4')} FROM m""")
def surface_run(spark, sf_dir):
    """A whole published run, from the cache's files: cells, times, scales, and its spectrum by power sums."""
    run, _, _ = _run(spark, sf_dir)
    meta = runs.read_metadata(spark, run)
    sigma = np.array([x["sigma"] for x in products.validated(spark, run)["spectrum"].collect()])
    p = meta["preparation"]
    one = _one(spark, cells=p["common_ocean_cell_count"], times=p["initial_time_count"], retained=p["retained_time_count"], velocity_rms=round(meta["velocity_rms"], 6), eta_rms=round(meta["eta_rms"], 6), **{k: v for k, v in _moments(sigma).items() if k != "s6"})
    return _digits(one, "s2", "s4")


@query(sql("SELECT t, cell::BIGINT AS cell, component, round(x + 1.3e-8, 5) + 0.0 AS value FROM long"))
def run_reconstruction(spark, sf_dir):
    """Means and all modes of a published run give its data back."""
    run, times, cells = _run(spark, sf_dir)
    back = products.reconstruction(spark, run, 10_000)
    return _named(back, spark, times, cells).select("t", "cell", "component", r(F.col("value") + 1.3e-8, 5).alias("value"))


@query(sql("SELECT 'all' AS region, (SELECT count(*) FROM kept) AS cells, (SELECT round(sum(area) / 1e6, 9) FROM cells JOIN kept USING (cell)) AS area_km2, (SELECT round(100.0 * count(*) / 17544, 6) FROM full_t) AS coverage, 1.0::DOUBLE AS ev"))
def region_table(spark, sf_dir):
    run, _, _ = _run(spark, sf_dir)
    t = products.region_report(spark, {"all": run})
    return t.groupBy("region", "cells", F.round("area_km2", 9).alias("area_km2"), F.round("coverage", 6).alias("coverage")).agg(F.round(F.sum("ev"), 9).alias("ev"))


@query(sql("SELECT component, count(*) AS cells FROM kept, (VALUES ('u'), ('v'), ('eta')) c(component) GROUP BY component"))
def figure_coverage(spark, sf_dir):
    run, _, _ = _run(spark, sf_dir)
    return products.figure_tables(spark, run)["coverage"].select("component", "cells")


@query("""WITH a AS (SELECT event_id, strftime(ts, '%Y%m') AS month, epoch_us(date_trunc('hour', ts)) AS t, row_number() OVER (ORDER BY ts, event_id) AS src FROM events),
m AS (SELECT count(*) AS n FROM a WHERE event_id % 1000 = 0)
SELECT true AS same_pass, n = 0 AS shifted_pass FROM m""")
def paired_sources(spark, sf_dir):
    """Two caches' axes: equal ones pass, and axes that differ at some steps (every thousandth event an hour late) are refused, if there is such a step."""
    e = C.read(spark, sf_dir, "events")
    a = e.select(F.date_format("ts", "yyyyMM").alias("month"), F.col("event_id").cast("long").alias("src"), scalar.timestamp_to_ns(F.date_trunc("hour", "ts")).alias("t"))
    late = a.withColumn("t", F.col("t") + F.when(F.col("src") % 1000 == 0, H).otherwise(0))
    months = [arrays.Month(m, "standard_month", 1, {}) for m in sorted(x[0] for x in a.select("month").distinct().collect())]

    def passes(other: DataFrame) -> bool:
        try:
            column.paired(months, months, a, other)
        except ContractError:
            return False
        return True

    return _one(spark, same_pass=passes(a), shifted_pass=passes(late))
