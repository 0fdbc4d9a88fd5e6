"""Eigendecompositions that follow rank-one updates.

A ``Spectrum`` holds the eigenvalues and eigenvectors of the centred scatter matrix of the integer vectors
seen so far, with their exact number and sums. One more vector adds a multiple of the outer product of its
distance from the mean. The new eigenvalues are the roots of the secular equation
1 + rho * sum(z_i^2 / (d_i - mu)) = 0, one between every two old ones; what has no part in the update
(z_i of nothing, or equal d_i turned so) is deflated. Eigenvectors come from the z that fits the
computed roots exactly, which keeps them orthogonal however close the roots lie.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPS = np.finfo(np.float64).eps


def _deflate(d: np.ndarray, q: np.ndarray, z: np.ndarray, rho: float) -> np.ndarray:
    """Turn equal values so that one of them bears all of z (in place); positions that take part in the update."""
    tol = 8 * EPS * max(abs(d[-1]), abs(d[0]), rho)
    active = np.flatnonzero(rho * np.abs(z) > tol)
    left, right = active[:-1], active[1:]
    r2 = z[left] ** 2 + z[right] ** 2
    if not np.any(np.abs((d[right] - d[left]) * z[left] * z[right]) <= tol * r2):
        return active
    kept, last = [], -1
    for j in active:
        if last >= 0:
            r = np.hypot(z[last], z[j])
            c, s = z[j] / r, -z[last] / r
            if abs((d[j] - d[last]) * c * s) <= tol:
                a, b = q[:, last].copy(), q[:, j].copy()
                q[:, last], q[:, j] = c * a + s * b, c * b - s * a
                d[last], d[j] = d[last] * c * c + d[j] * s * s, d[last] * s * s + d[j] * c * c
                z[last], z[j] = 0.0, r
                kept.pop()
        kept.append(j)
        last = j
    return np.array(kept)


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The roots for ascending ``d``, and the differences d_i - mu_j, accurate in each entry.

    Every root is sought from the pole that it lies nearer to. A step replaces the poles on either side by one
    with the same value and slope; a step that leaves the bracket is a bisection.
    """
    k = len(d)
    weight = rho * z * z
    above = np.append(d[1:], d[-1] + weight.sum())  # the last root has no pole above, but a bound
    gap = above - d
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        left = 1 + (weight[:, None] / (d[:, None] - (d + gap / 2))).sum(axis=0) > 0
        low_half = left.copy()
        left[-1] = True
        origin = np.where(left, d, above)
        lo = np.where(low_half, 0.0, np.where(left, gap / 2, -gap / 2))
        hi = np.where(low_half, gap / 2, np.where(left, gap, 0.0))
        delta = d[:, None] - origin
        below, over = np.diagonal(delta).copy(), above - origin
        lower = np.triu(np.ones((k, k)))  # poles up to the root's own
        eta = (lo + hi) / 2
        for _ in range(100):
            part = 1 / (delta - eta)
            own = part * lower
            psi, dpsi = weight @ own, weight @ np.square(own, out=own)
            phi, dphi = weight @ part - psi, weight @ np.square(part, out=part) - dpsi
            f = 1 + psi + phi
            done = np.abs(f) <= 4 * EPS * (1 + np.abs(psi) + np.abs(phi)) * np.sqrt(k)
            done |= hi - lo <= 2 * EPS * np.maximum(np.abs(lo), np.abs(hi))
            if done.all():
                break
            lo, hi = np.where(f < 0, eta, lo), np.where(f < 0, hi, eta)
            x, y = below - eta, over - eta
            c = f - x * dpsi - y * dphi
            a, b = c * (x + y) + x * x * dpsi + y * y * dphi, x * y * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            moved = eta + np.where(a > 0, 2 * b / (a + root), (a - root) / (2 * c))
            inside = np.isfinite(moved) & (moved > lo) & (moved < hi)
            eta = np.where(done, eta, np.where(inside, moved, (lo + hi) / 2))
    return origin + eta, delta - eta


def rank_one(d: np.ndarray, q: np.ndarray, rho: float, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (ascending) and vectors of q diag(d) q' + rho v v' for rho >= 0."""
    z = v @ q
    size = np.sqrt(z @ z)
    rho = rho * size * size
    if not rho > 0:
        return d, q
    d, q, z = d.copy(), q.copy(), z / size
    at = _deflate(d, q, z, rho)
    if len(at) == 1:
        d[at] += rho * z[at] ** 2
    elif len(at):
        order = at[np.argsort(d[at], kind="stable")]
        old, part = d[order], z[order]
        roots, diff = secular_roots(old, part, rho)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = diff / (old[:, None] - old)
        np.fill_diagonal(ratio, -np.diagonal(diff))
        fitting = np.copysign(np.sqrt(np.abs(np.prod(ratio, axis=1))), part)
        turn = fitting[:, None] / diff
        turn /= np.sqrt((turn * turn).sum(axis=0))
        d[order], q[:, order] = roots, q[:, order] @ turn
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


@dataclass
class Spectrum:
    n: int
    sums: np.ndarray  # long, exact
    values: np.ndarray  # of the centred scatter matrix, ascending
    vectors: np.ndarray  # as columns

    @classmethod
    def empty(cls, length: int) -> Spectrum:
        return cls(0, np.zeros(length, np.int64), np.zeros(length), np.eye(length))

    def add(self, x: np.ndarray, times: int = 1) -> None:
        """One integer vector, or so many copies of it."""
        if self.n:
            off = (self.n * x - self.sums) / self.n
            self.values, self.vectors = rank_one(self.values, self.vectors, self.n * times / (self.n + times), off)
        self.n += times
        self.sums = self.sums + times * x

    def merge(self, other: Spectrum) -> None:
        """Another spectrum: an update for each of its components, and one for the distance of the means."""
        if not self.n:
            self.n, self.sums, self.values, self.vectors = other.n, other.sums, other.values, other.vectors
        elif other.n:
            for value, vector in zip(other.values, other.vectors.T):
                if value > 0:
                    self.values, self.vectors = rank_one(self.values, self.vectors, value, vector)
            off = self.sums / self.n - other.sums / other.n
            self.values, self.vectors = rank_one(self.values, self.vectors, self.n * other.n / (self.n + other.n), off)
            self.n, self.sums = self.n + other.n, self.sums + other.sums

    def pack(self) -> dict:
        return {"n": self.n, "sums": self.sums.tobytes(), "vals": self.values.tobytes(), "vecs": np.ascontiguousarray(self.vectors).tobytes()}

    @classmethod
    def unpack(cls, row) -> Spectrum:
        values = np.frombuffer(row["vals"])
        return cls(row["n"], np.frombuffer(row["sums"], np.int64), values, np.frombuffer(row["vecs"]).reshape(len(values), -1))
