"""A matrix (feature by time) as blocks of columns, and the products that solvers need.

A block holds all features at a few times, in one binary row. Products with a thin matrix run where
the blocks are; what comes to the driver is as thin as the factor, never the matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = "block int, t0 long, n int, data binary"
BLOCK_BYTES = 64 << 20


@dataclass(frozen=True)
class BlockMatrix:
    blocks: DataFrame
    n_features: int
    n_times: int


def kept(m: BlockMatrix) -> BlockMatrix:
    """The matrix with its blocks kept on the executors: solvers pass over them again and again. A lost block is made again."""
    from pyspark import StorageLevel

    return BlockMatrix(m.blocks.persist(StorageLevel.MEMORY_AND_DISK), m.n_features, m.n_times)


@dataclass(frozen=True)
class Held:
    """A factor (times by k) that the driver holds."""

    values: np.ndarray

    @property
    def width(self) -> int:
        return self.values.shape[1]

    def rows(self, x: np.ndarray, t0: int) -> np.ndarray:
        return self.values[t0 : t0 + x.shape[1]]

    def scaled(self, by: np.ndarray) -> Held:
        return Held(self.values * by)


@dataclass(frozen=True)
class Spread:
    """A factor A^T W C (times by k) that nobody holds: tasks make its rows from their blocks. W and C are as long as the features and the modes."""

    w: np.ndarray
    c: np.ndarray

    @property
    def width(self) -> int:
        return self.c.shape[1]

    def rows(self, x: np.ndarray, t0: int) -> np.ndarray:
        return (x.T @ self.w) @ self.c

    def scaled(self, by: np.ndarray) -> Spread:
        return Spread(self.w, self.c * by)


@dataclass(frozen=True)
class Drawn:
    """A random factor (times by k), drawn block by block."""

    seed: int
    width: int

    def rows(self, x: np.ndarray, t0: int) -> np.ndarray:
        return np.random.default_rng((self.seed, t0)).standard_normal((x.shape[1], self.width))


Factor = Held | Spread | Drawn


def opened(data: bytes, n_features: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<f8").reshape(n_features, -1)


def _dealt(df: DataFrame, key: str, n_keys: int) -> DataFrame:
    """Rows dealt by a key of ``n_keys`` values: to no more tasks than it has values, however many partitions shuffles have."""
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, min(n_keys, most)), key)


def to_blocks(long: DataFrame, n_features: int, n_times: int, width: int = 64, feature: str = "feature_id", time: str = "t_idx", value: str = "x") -> BlockMatrix:
    """From (feature_id, t_idx, x), one row per element, to blocks of ``width`` times; absent elements raise."""
    src = long.select((F.col(time) / width).cast("int").alias("block"), F.col(feature).cast("long").alias("f"), F.col(time).cast("long").alias("t"), F.col(value).cast("double").alias("x"))

    def gather(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        t0 = block * width
        n = min(width, n_times - t0)
        out = np.full((n_features, n), np.nan)
        out[np.asarray(t.column("f")), np.asarray(t.column("t")) - t0] = np.asarray(t.column("x"))
        if not np.isfinite(out).all():
            raise ValueError("the matrix has missing or infinite elements")
        return pa.table({"block": pa.array([block], pa.int32()), "t0": pa.array([t0], pa.int64()), "n": pa.array([n], pa.int32()), "data": pa.array([out.astype("<f8").tobytes()], pa.binary())})

    return BlockMatrix(_dealt(src, "block", -(-n_times // width)).groupBy("block").applyInArrow(gather, BLOCK), n_features, n_times)


def from_rows(rows: DataFrame, n_features: int, vector: str, key: str, width: int = 64, most_blocks: int = 4096) -> BlockMatrix:
    """From one vector per row (``vector`` is an array) to blocks: no explode, and no order over all rows.

    Rows are dealt by a hash of their key and sorted by it within a block; their place in the matrix follows from the
    blocks' sizes. There are ``most_blocks`` at most while these hold no more than BLOCK_BYTES, which bounds a task's memory.
    """
    n = rows.count()
    n_blocks = max(1, min(most_blocks, -(-n // width)), -(-8 * n * n_features // BLOCK_BYTES))
    src = rows.select(F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int").alias("block"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    first, n_times = {}, 0
    for r in src.groupBy("block").agg(F.count(F.lit(1)).alias("n")).orderBy("block").collect():
        first[r["block"]] = n_times
        n_times += r["n"]

    def gather(t: pa.Table) -> pa.Table:
        t = t.sort_by("key").combine_chunks()
        block = t.column("block")[0].as_py()
        out = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, n_features).T
        return pa.table({"block": pa.array([block], pa.int32()), "t0": pa.array([first[block]], pa.int64()), "n": pa.array([out.shape[1]], pa.int32()), "data": pa.array([np.ascontiguousarray(out).astype("<f8").tobytes()], pa.binary())})

    return BlockMatrix(src.groupBy("block").applyInArrow(gather, BLOCK), n_features, n_times)


def _stripes(parts, stripe_rows: int) -> pa.RecordBatch:
    """(block, stripe, data) rows of matrices, cut into stripes so that sums are spread over tasks."""
    rows = [(b, i, m[a : a + stripe_rows].tobytes()) for b, m in parts for i, a in enumerate(range(0, len(m), stripe_rows))]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["block", "stripe", "data"])


def _summed(parts: DataFrame, n_rows: int, n_cols: int, stripe_rows: int) -> np.ndarray:
    def add(t: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(t.column("block")), kind="stable")  # the same order of addition every time
        total = None
        for i in order.tolist():
            m = np.frombuffer(t.column("data")[i].as_py())
            total = m.copy() if total is None else total + m
        return pa.table({"stripe": t.column("stripe").slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})

    got = {r["stripe"]: np.frombuffer(r["data"]) for r in _dealt(parts, "stripe", -(-n_rows // stripe_rows)).groupBy("stripe").applyInArrow(add, "stripe int, data binary").collect()}
    out = np.zeros((n_rows, n_cols))
    for i, a in enumerate(range(0, n_rows, stripe_rows)):
        out[a : a + stripe_rows] = got[i].reshape(-1, n_cols)
    return out


def gram(m: BlockMatrix, stripe_rows: int = 256) -> np.ndarray:
    """A A^T (features by features): a partial sum per task, stripes added up on the executors."""

    rows = m.n_features

    def run(batches):
        total, first = None, 0
        for b in batches:
            for r in b.to_pylist():
                x = opened(r["data"], rows)
                total, first = (x @ x.T, r["block"]) if total is None else (total + x @ x.T, min(first, r["block"]))
        if total is not None:
            yield _stripes([(first, total)], stripe_rows)

    return _summed(m.blocks.mapInArrow(run, "block int, stripe int, data binary"), m.n_features, m.n_features, stripe_rows)


def _folded(m: BlockMatrix, shared, part, n_rows: int, n_cols: int, stripe_rows: int = 4096) -> np.ndarray:
    """The sum over blocks of ``part(x, t0, shared)``, a matrix of a size that doesn't depend on the times."""
    rows, sent = m.n_features, m.blocks.sparkSession.sparkContext.broadcast(shared)

    def run(batches):
        total, first = None, 0
        for b in batches:
            for r in b.to_pylist():
                y = part(opened(r["data"], rows), r["t0"], sent.value)
                total, first = (y, r["block"]) if total is None else (total + y, min(first, r["block"]))
        if total is not None:
            yield _stripes([(first, np.ascontiguousarray(total))], stripe_rows)

    return _summed(m.blocks.mapInArrow(run, "block int, stripe int, data binary"), n_rows, n_cols, stripe_rows)


def times_right(m: BlockMatrix, v: Factor | np.ndarray) -> np.ndarray:
    """A V for a thin V (times by k)."""
    v = Held(np.ascontiguousarray(v)) if isinstance(v, np.ndarray) else v
    return _folded(m, v, lambda x, t0, f: x @ f.rows(x, t0), m.n_features, v.width)


def factor_gram(m: BlockMatrix, v: Factor) -> np.ndarray:
    """V^T V."""

    def part(x, t0, f):
        y = f.rows(x, t0)
        return y.T @ y

    return _folded(m, v, part, v.width, v.width)


def departures(m: BlockMatrix, u: np.ndarray, s: np.ndarray, v: Factor) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A V, V^T V, squared norms of the columns of A^T U - V S), in one pass."""

    def part(x, t0, shared):
        u, s, f = shared
        y = f.rows(x, t0)
        return np.vstack([x @ y, y.T @ y, ((x.T @ u - y * s) ** 2).sum(axis=0)])

    n, k = u.shape
    out = _folded(m, (np.ascontiguousarray(u), s, v), part, n + k + 1, k)
    return out[:n], out[n:-1], out[-1]


def together(m: BlockMatrix, v: Factor) -> np.ndarray:
    """A factor's rows on the driver (times by k): for axes that it has room for."""
    return v.values if isinstance(v, Held) else times_left(m, v.w) @ v.c


def times_left(m: BlockMatrix, u: np.ndarray) -> np.ndarray:
    """A^T U for a thin U (features by k): a slice per block, put together by time."""
    rows, shared = m.n_features, m.blocks.sparkSession.sparkContext.broadcast(np.ascontiguousarray(u))

    def run(batches):
        for b in batches:
            out = [(r["t0"], (opened(r["data"], rows).T @ shared.value).tobytes()) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], ["t0", "data"])

    out = np.zeros((m.n_times, u.shape[1]))
    for r in m.blocks.mapInArrow(run, "t0 long, data binary").collect():
        y = np.frombuffer(r["data"]).reshape(-1, u.shape[1])
        out[r["t0"] : r["t0"] + len(y)] = y
    return out


def frobenius2(m: BlockMatrix) -> float:
    rows = m.n_features

    def run(batches):
        for b in batches:
            out = [(r["t0"], float((opened(r["data"], rows) ** 2).sum())) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.float64())], ["t0", "x"])

    return float(sum(r["x"] for r in sorted(m.blocks.mapInArrow(run, "t0 long, x double").collect())))


def collected(m: BlockMatrix) -> np.ndarray:
    """The whole matrix on the driver; callers hold its size against their limit first."""
    out = np.zeros((m.n_features, m.n_times))
    for r in m.blocks.collect():
        out[:, r["t0"] : r["t0"] + r["n"]] = opened(r["data"], m.n_features)
    return out


def triangle(m: BlockMatrix, fan_in: int = 8, basis: np.ndarray | None = None) -> np.ndarray:
    """R of A^T = Q R by a tree of QR decompositions; A^T A is never formed. With a ``basis`` (features by k), of A^T times it."""

    n_features = m.n_features
    rows = n_features if basis is None else basis.shape[1]
    shared = None if basis is None else m.blocks.sparkSession.sparkContext.broadcast(np.ascontiguousarray(basis))

    def local(batches):
        r_factor, first = None, 0
        for b in batches:
            for r in b.to_pylist():
                x = opened(r["data"], n_features).T
                x = x if shared is None else x @ shared.value
                r_factor, first = (x, r["block"]) if r_factor is None else (np.vstack([r_factor, x]), min(first, r["block"]))
                if len(r_factor) > 2 * rows:
                    r_factor = np.linalg.qr(r_factor, mode="r")
        if r_factor is not None:
            r_factor = np.linalg.qr(r_factor, mode="r") if len(r_factor) > rows else r_factor
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([first], pa.int32()), pa.array([np.ascontiguousarray(r_factor).tobytes()], pa.binary())], ["place", "block", "data"])

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(t.column("block")))
        whole = np.vstack([np.frombuffer(t.column("data")[i].as_py()).reshape(-1, rows) for i in order.tolist()])
        whole = np.linalg.qr(whole, mode="r") if len(whole) > rows else whole
        return pa.table({"place": pa.array([key[0].as_py()], pa.int64()), "block": pa.array([min(t.column("block").to_pylist())], pa.int32()), "data": pa.array([np.ascontiguousarray(whole).tobytes()], pa.binary())})

    parts = m.blocks.mapInArrow(local, "place long, block int, data binary")
    n = max(1, m.blocks.rdd.getNumPartitions())
    while n > 1:  # tasks are numbered, so their factors meet by number: none but the merging tasks sees them
        parts = parts.groupBy(F.floor(F.col("place") / fan_in).alias("part")).applyInArrow(lambda key, t: merge(key, t), "place long, block int, data binary")
        n = -(-n // fan_in)
    whole = np.vstack([np.frombuffer(r["data"]).reshape(-1, rows) for r in sorted(parts.collect(), key=lambda r: r["block"])])
    return np.linalg.qr(whole, mode="r")
