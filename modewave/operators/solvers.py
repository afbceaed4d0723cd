"""Singular value decompositions of block matrices.

``by_covariance`` takes the eigenvectors of the covariance; the others are direct and never form A A^T: dense on the driver
within a memory limit, a QR tree while the short side is moderate, and a block Golub-Kahan Krylov space beyond. All direct results
must pass residual and orthogonality gates.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np

from ..errors import require
from .blocks import BlockMatrix, Drawn, Factor, Held, Spread, collected, departures, factor_gram, frobenius2, gram, times_left, times_right, together, triangle

RESIDUAL_FLOOR, ORTHOGONALITY = 1e-8, 1e-10
QR_SIDE = 3000


@dataclass(frozen=True)
class Svd:
    """u: features by modes, s: descending, right: times by modes (unit columns), total: sum of squares of A.

    The right factor stays where the blocks are until ``v`` or ``pc`` is asked for, which bring it to the driver."""

    u: np.ndarray
    s: np.ndarray
    right: Factor
    matrix: BlockMatrix
    total: float
    solver: str
    all_ev: np.ndarray | None = None
    rank: int = 0
    left_residual: float = 0.0
    right_residual: float = 0.0
    orthogonality: float = 0.0
    attempts: list = field(default_factory=list)

    @property
    def n_times(self) -> int:
        return self.matrix.n_times

    @cached_property
    def v(self) -> np.ndarray:
        return together(self.matrix, self.right)

    @property
    def pc(self) -> np.ndarray:
        """Modes by times: sigma V^T."""
        return self.s[:, None] * self.v.T

    @property
    def explained(self) -> np.ndarray:
        return self.s**2 / self.total

    @property
    def shares(self) -> np.ndarray:
        """Explained shares of all modes that the solver found, those beyond the requested ones too where it did."""
        return self.explained if self.all_ev is None else self.all_ev

    @property
    def cumulative(self) -> np.ndarray:
        return np.cumsum(self.explained)

    @property
    def retained_error(self) -> float:
        """Relative error of the reconstruction from these modes."""
        return float(np.sqrt(max(0.0, 1.0 - float((self.s**2).sum()) / self.total)))

    def flipped(self, signs: np.ndarray) -> Svd:
        return replace(self, u=self.u * signs, right=self.right.scaled(signs))


def mode_count(values: np.ndarray, shape: tuple[int, int], requested: int, least: int) -> tuple[int, int]:
    """(modes, numerical rank) of descending values (eigenvalues or singular values)."""
    floor = max(float(values[0]) * np.finfo(float).eps * max(shape), np.finfo(float).tiny)
    rank = int((values > floor).sum())
    modes = min(requested, rank)
    require(modes >= least, f"rank {rank}, at least {least} modes are needed")
    return modes, rank


def covariance_bytes(n_features: int) -> int:
    """What the covariance and its eigenvectors take, in a task and on the driver."""
    return 3 * 8 * n_features**2


def by_covariance(m: BlockMatrix, requested: int, least: int = 1, memory_bytes: int = 1 << 30) -> Svd:
    """Features are few and times many: the covariance is summed on the executors, its eigenvectors are found on the driver. Beyond ``memory_bytes`` a direct solver."""
    if covariance_bytes(m.n_features) > memory_bytes:
        return direct(m, requested, least, memory_bytes)
    cov = gram(m) / (m.n_times - 1)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    require(float(values.sum()) > 0, "nothing varies")
    k, rank = mode_count(values, (m.n_features, m.n_times), requested, least)
    u = vectors[:, :k].copy()
    s = np.sqrt(values[:k] * (m.n_times - 1))
    orth = float(np.abs(u.T @ u - np.eye(k)).max())
    return Svd(u, s, Spread(u, np.diag(1 / s)), m, float(values.sum()) * (m.n_times - 1), "covariance_eigh", values / values.sum(), rank, orthogonality=orth)


def dense_bytes(rows: int, cols: int) -> int:
    """What a dense decomposition holds at once: the matrix, both factors and a work area."""
    short = min(rows, cols)
    sizes = [8 * rows * cols, 8 * rows * short, 8 * short * cols]
    return sum(sizes) + 2 * max(sizes)


def residuals(m: BlockMatrix, u: np.ndarray, s: np.ndarray, v: Factor) -> tuple[float, float, float]:
    """Largest relative residuals of both sides, and the largest departure from orthonormal columns."""
    av, vv, right2 = departures(m, u, s, v)
    left, right = np.linalg.norm(av - u * s, axis=0) / s, np.sqrt(right2) / s
    eye = np.eye(len(s))
    return float(left.max()), float(right.max()), float(max(np.abs(u.T @ u - eye).max(), np.abs(vv - eye).max()))


def _right(m: BlockMatrix, u: np.ndarray, s: np.ndarray) -> Spread:
    """Right vectors A^T U / S, made orthonormal among themselves (the Cholesky form of a QR decomposition), as their rounding errors grow with s[0] / s."""
    v = Spread(u, np.diag(1 / s))
    try:
        return replace(v, c=np.linalg.solve(np.linalg.cholesky(factor_gram(m, v)), v.c.T).T)
    except np.linalg.LinAlgError:  # far from orthonormal: the gates tell
        return v


def _gated(m: BlockMatrix, u, s, v: Factor, total, solver, tolerance, attempts=()) -> tuple[Svd, bool]:
    left, right, orth = residuals(m, u, s, v)
    ok = max(left, right) <= max(tolerance, RESIDUAL_FLOOR) and orth <= ORTHOGONALITY
    return Svd(u, s, v, m, total, solver, None, len(s), left, right, orth, list(attempts)), ok


def dense(m: BlockMatrix, requested: int, least: int = 1, tolerance: float = 1e-9) -> Svd:
    a = collected(m)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    k, _ = mode_count(s, a.shape, requested, least)
    out, ok = _gated(m, u[:, :k], s[:k], Held(vt[:k].T), float((s**2).sum()), "dense", tolerance)
    require(ok, f"residuals {out.left_residual:.3g}, {out.right_residual:.3g}, orthogonality {out.orthogonality:.3g}")
    return out


def qr_tree(m: BlockMatrix, requested: int, least: int = 1, tolerance: float = 1e-9) -> Svd:
    r = triangle(m)
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    k, _ = mode_count(s, (m.n_features, m.n_times), requested, least)
    u = vt[:k].T
    out, ok = _gated(m, u, s[:k], _right(m, u, s[:k]), float((s**2).sum()), "qr_tree", tolerance)
    require(ok, f"residuals {out.left_residual:.3g}, {out.right_residual:.3g}, orthogonality {out.orthogonality:.3g}")
    return out


def _orthonormal(x: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for b in basis:
            x = x - b @ (b.T @ x)
    q, r = np.linalg.qr(x)
    d = np.abs(np.diag(r))
    return q[:, d > 1e-13 * max(1.0, float(d.max(initial=0.0)))] if len(d) else q


def _unit(left: np.ndarray, r: np.ndarray) -> Spread:
    """An orthonormal basis of A^T L from its triangular factor; directions that are rounding errors are left off."""
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    ok = s > 1e-13 * s[0]
    return Spread(left, vt[ok].T / s[ok])


def krylov(m: BlockMatrix, requested: int, least: int = 1, tolerance: float = 1e-9, rounds: int = 10, attempts: int = 3, seed: int = 0, basis_bytes: int = 2 << 30) -> Svd:
    """Top modes from a block Krylov space with full reorthogonalisation. A failed attempt doubles the rounds; after the last it raises.

    Where times outnumber features, nothing as long as the axis comes to the driver: images and right vectors stay spread, known by triangular factors.
    A basis that outgrows ``basis_bytes`` on the driver (an eighth of them where tasks get it) is cut back to its best ``wide`` vectors, whose images follow
    from theirs, and grows again from there.
    """
    total = frobenius2(m)
    k = min(requested, m.n_features, m.n_times)
    wide = min(m.n_features, m.n_times, k + 8)
    spread = m.n_times > m.n_features
    tried: list[dict] = []
    per = 8 * wide * (8 * m.n_features if spread else m.n_features + m.n_times)
    most = max(3, basis_bytes // per)  # blocks of the basis that fit
    lefts: list[np.ndarray] = []
    images: list[np.ndarray] = []  # A^T of each left block, where they are held
    nxt: Factor = Drawn(seed, wide) if spread else Held(np.linalg.qr(np.random.default_rng(seed).standard_normal((m.n_times, wide)))[0])
    done = 0

    def best_of(q: np.ndarray) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
        """(V or none where it is spread, S, W^T) of A^T Q."""
        if spread:
            return None, *np.linalg.svd(triangle(m, basis=q), full_matrices=False)[1:]
        return np.linalg.svd(np.hstack(images), full_matrices=False)

    best: Svd | None = None
    for attempt in range(attempts):
        goal, exhausted = rounds << attempt, False
        while done < goal and not exhausted:
            if len(lefts) >= most:
                q = np.hstack(lefts)
                wt = best_of(q)[2][:wide]
                lefts, images = [q @ wt.T], [] if spread else [np.hstack(images) @ wt.T]
                nxt = _unit(lefts[0], triangle(m, basis=lefts[0])) if spread else Held(np.linalg.qr(images[0])[0])
            left = _orthonormal(times_right(m, nxt), lefts)
            exhausted = not left.shape[1]
            if not exhausted:
                lefts.append(left)
                if spread:
                    nxt = _unit(left, triangle(m, basis=left))
                else:
                    images.append(times_left(m, left))
                    nxt = Held(np.linalg.qr(images[-1])[0])
                done += 1
            if not exhausted and done % 2 and done < goal:
                continue
            q = np.hstack(lefts)
            v, s, wt = best_of(q)
            n, _ = mode_count(s, (m.n_features, m.n_times), k, 1)
            u = q @ wt[:n].T
            best, ok = _gated(m, u, s[:n], _right(m, u, s[:n]) if spread else Held(v[:, :n]), total, "block_krylov", tolerance, tried)
            if ok:
                require(n >= least, f"rank {n}, at least {least} modes are needed")
                return best
        tried.append({"attempt": attempt + 1, "rounds": done, "left": best.left_residual, "right": best.right_residual, "orthogonality": best.orthogonality})
    raise RuntimeError(f"no attempt converged: {tried}")


def direct(m: BlockMatrix, requested: int, least: int = 1, memory_bytes: int = 1 << 30, tolerance: float = 1e-9, rounds: int = 10, attempts: int = 3, seed: int = 0) -> Svd:
    """The direct solver that the matrix' size calls for."""
    if dense_bytes(m.n_features, m.n_times) <= memory_bytes:
        return dense(m, requested, least, tolerance)
    if m.n_features <= min(QR_SIDE, m.n_times):
        return qr_tree(m, requested, least, tolerance)
    return krylov(m, requested, least, tolerance, rounds, attempts, seed)
