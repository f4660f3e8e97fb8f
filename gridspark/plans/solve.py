"""Least squares from sufficient statistics: distributed sums, a small dense solve on the driver."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_scale(total: np.ndarray, squares: np.ndarray, n: float) -> np.ndarray:
    """Population standard deviation of every column, 1 for constant ones; weights play no part."""
    mean = total / n
    var = np.maximum(squares / n - mean * mean, 0)
    flat = var <= 10 * np.finfo(float).eps * n * np.maximum(squares / n, np.finfo(float).tiny)
    return np.where(flat, 1.0, np.sqrt(var))


def solve_gram(gram: np.ndarray, right: np.ndarray, scale: np.ndarray, damping: float | None = None) -> np.ndarray:
    """Parameters of the (ridge) problem on scaled columns, unscaled again; minimum norm if singular."""
    g, b = gram / np.outer(scale, scale), right / scale
    if damping is not None:
        return np.linalg.solve(g + damping * np.eye(len(g)), b) / scale
    try:
        if np.linalg.cond(g) < 1e13:
            return np.linalg.solve(g, b) / scale
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(g, b, rcond=None)[0] / scale


def least_squares(jacobian: np.ndarray, data: np.ndarray, weights: np.ndarray | None = None, damping: float | None = None) -> np.ndarray:
    """The same problem from a matrix on the driver, for bounded sizes."""
    if jacobian.shape[0] < jacobian.shape[1]:
        warnings.warn(f"Fewer data than parameters: {jacobian.shape}", UserWarning, stacklevel=2)
    scale = column_scale(jacobian.sum(0), (jacobian**2).sum(0), len(jacobian))
    scaled = jacobian / scale
    root = np.ones(len(data)) if weights is None else np.sqrt(weights)
    a, b = scaled * root[:, None], np.asarray(data, float) * root
    if damping is not None:
        return np.linalg.solve(a.T @ a + damping * np.eye(a.shape[1]), a.T @ b) / scale
    return np.linalg.lstsq(a, b, rcond=None)[0] / scale


def terms(degree: int) -> list[tuple[int, int]]:
    """Powers (i, j) of a polynomial: by total degree, then descending i."""
    if degree < 0:
        raise ValueError(f"A polynomial has degree 0 or more, not {degree}")
    return [(d - j, j) for d in range(degree + 1) for j in range(d + 1)]


class Moments:
    """Power sums of centred, scaled coordinates, per group if asked: all that a polynomial fit needs.

    One scan computes the sums of w e^i n^j for i + j <= 2 N, of w e^i n^j d for i + j <= N, and
    the unweighted ones for the column scale; every group is one small row.
    """

    def __init__(self, degree: int, region):
        self.degree, self.pairs = degree, terms(2 * degree)
        w, e, s, n = region
        self.center = ((w + e) / 2, (s + n) / 2)
        self.half = (max((e - w) / 2, 0) or 1.0, max((n - s) / 2, 0) or 1.0)

    def aggregates(self, coords, data, weights) -> list:
        x = (F.col(coords[0]) - self.center[0]) / self.half[0]
        y = (F.col(coords[1]) - self.center[1]) / self.half[1]

        def power(i, j):
            out = F.lit(1.0)
            for _ in range(i):
                out = out * x
            for _ in range(j):
                out = out * y
            return out

        out = []
        for k, d in enumerate(data):
            w = F.lit(1.0) if weights is None else F.col(weights[k])
            ok = F.col(d).isNotNull() & x.isNotNull() & y.isNotNull()
            for i, j in self.pairs:
                out.append(F.sum(F.when(ok, w * power(i, j))).alias(f"g{k}_{i}_{j}"))
                if weights is not None:
                    out.append(F.sum(F.when(ok, power(i, j))).alias(f"u{k}_{i}_{j}"))
            for i, j in terms(self.degree):
                out.append(F.sum(F.when(ok, w * power(i, j) * F.col(d))).alias(f"b{k}_{i}_{j}"))
        return out

    def coefficients(self, row: dict, k: int, weighted: bool) -> np.ndarray:
        """Polynomial coefficients in raw coordinates for component ``k``."""
        t = terms(self.degree)
        sums = {p: row[f"g{k}_{p[0]}_{p[1]}"] for p in self.pairs}
        if sums[0, 0] is None:
            raise ValueError("A trend needs at least one datum")
        plain = {p: row[f"u{k}_{p[0]}_{p[1]}"] for p in self.pairs} if weighted else sums
        gram = np.array([[sums[a + c, b + d] for c, d in t] for a, b in t])
        right = np.array([row[f"b{k}_{i}_{j}"] for i, j in t])
        n = plain[0, 0]
        if n < len(t):
            warnings.warn(f"Fewer data than parameters: ({n:g}, {len(t)})", UserWarning, stacklevel=3)
        to_raw = self._expansion(t)
        scale = column_scale(np.array([plain[i, j] for i, j in t]), np.array([plain[2 * i, 2 * j] for i, j in t]), n)
        scaled = gram / np.outer(scale, scale)
        if np.linalg.matrix_rank(scaled) == len(t):
            return to_raw @ (np.linalg.solve(scaled, right / scale) / scale)
        # deficient: minimum norm in raw scaled columns, as a dense solver would give
        back = np.linalg.inv(to_raw)
        raw, b = back.T @ gram @ back, back.T @ right
        u = np.array([[plain[a + c, b_ + d] for c, d in t] for a, b_ in t])
        u = back.T @ u @ back
        const = t.index((0, 0))
        scale = column_scale(u[const], np.diag(u), n)
        return np.linalg.lstsq(raw / np.outer(scale, scale), b / scale, rcond=1e-12)[0] / scale

    def _expansion(self, t) -> np.ndarray:
        """Matrix from coefficients of ((e - c) / h)^i ((n - c) / h)^j to those of e^p n^q."""
        out = np.zeros((len(t), len(t)))
        place = {p: k for k, p in enumerate(t)}
        for (i, j), col in place.items():
            for p in range(i + 1):
                for q in range(j + 1):
                    out[place[p, q], col] += math.comb(i, p) * (-self.center[0]) ** (i - p) / self.half[0] ** i * math.comb(j, q) * (-self.center[1]) ** (j - q) / self.half[1] ** j
        return out


_METRICS = ("r2", "neg_mean_squared_error", "neg_root_mean_squared_error", "neg_mean_absolute_error", "max_error", "neg_max_error", "explained_variance")


def metric(df: DataFrame, scoring: str, data, predicted, weights=None) -> float:
    """A score per component in one aggregation, then their plain mean."""
    if scoring not in _METRICS:
        raise ValueError(f"Unknown score {scoring!r}; known: {_METRICS}")
    columns = []
    means = df.agg(*[(F.sum(F.col(d) * (F.col(w) if w else F.lit(1.0))) / F.sum(F.when(F.col(d).isNotNull(), F.col(w) if w else F.lit(1.0)))).alias(f"m{k}") for k, (d, w) in enumerate(zip(data, weights or [None] * len(data), strict=True))]).first()
    for k, (d, p) in enumerate(zip(data, predicted, strict=True)):
        w = F.col(weights[k]) if weights else F.lit(1.0)
        error = F.col(d) - F.col(p)
        mid = F.col(d) - F.lit(means[k])
        ok = error.isNotNull()
        total = F.sum(F.when(ok, w))
        columns += [x.alias(f"{n}{k}") for n, x in (("w", total), ("se", F.sum(w * error * error)), ("ae", F.sum(w * F.abs(error))), ("e", F.sum(w * error)), ("ss", F.sum(F.when(ok, w * mid * mid))), ("mx", F.max(F.abs(error))))]
    row = df.agg(*columns).first()
    out = []
    for k in range(len(data)):
        w, se, ae, e, ss, mx = (row[f"{n}{k}"] for n in ("w", "se", "ae", "e", "ss", "mx"))
        if not w:
            return float("nan")
        if scoring == "r2":
            out.append(1 - se / ss if ss else (1.0 if se == 0 else 0.0))
        elif scoring == "neg_mean_squared_error":
            out.append(-se / w)
        elif scoring == "neg_root_mean_squared_error":
            out.append(-math.sqrt(se / w))
        elif scoring == "neg_mean_absolute_error":
            out.append(-ae / w)
        elif scoring == "explained_variance":
            out.append(1 - (se / w - (e / w) ** 2) / (ss / w) if ss else 1.0)
        else:
            out.append(mx if scoring == "max_error" else -mx)
    return float(np.mean(out))
