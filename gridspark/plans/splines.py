"""Green's-function splines for scalar data and coupled two-component data."""

from __future__ import annotations

import functools
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.plans.base import FittedGridder, Gridder, region_of
from gridspark.plans.exact import KernelSum, solve
from gridspark.plans.solve import column_scale, least_squares, solve_gram
from gridspark.spec import SpatialFrame

#: Data whose dense matrix the driver solves; exact splines of more take an iteration in linear memory.
MAX_DENSE = 3_000
#: Data and forces of damped and vector splines without own forces at most: the matrix has their square.
MAX_EXACT = 10_000
#: Forces that damped fits broadcast at most, and that predictions sum one by one.
MAX_FORCES = 10_000


def biharmonic(de: np.ndarray, dn: np.ndarray, mindist: float) -> np.ndarray:
    r = np.hypot(de, dn) + mindist
    with np.errstate(divide="ignore", invalid="ignore"):
        near = np.where(r > 0, r * (r * np.log(np.where(r > 0, r, 1)) - r), 0.0)
        return np.where(r < 1, near, r * r * (np.log(np.where(r > 0, r, 1)) - 1))


def _many(de: np.ndarray, dn: np.ndarray, mindist: float) -> np.ndarray:
    """``biharmonic`` with one logarithm and few copies, for the sums of an exact spline of many points."""
    r = de * de + dn * dn
    if mindist:
        r = (np.sqrt(r) + mindist) ** 2
    out = np.log(np.maximum(r, 1e-300))
    out *= 0.5
    out -= 1
    out *= r
    return out


def elastic(de: np.ndarray, dn: np.ndarray, poisson: float, mindist: float) -> np.ndarray:
    """Blocks [[ee, ne], [ne, nn]] stacked by component."""
    r = np.hypot(de, dn) + mindist
    shared, over = (3 - poisson) * np.log(r), (1 + poisson) / r**2
    ne = -over * de * dn
    return np.block([[shared + over * dn**2, ne], [ne, shared + over * de**2]])


def _bounded(df: DataFrame, columns, most: int, what: str) -> np.ndarray:
    """Rows on the driver, refused above a size."""
    rows = df.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows: reduce by blocks first, or give fewer force_coords with damping")
    return np.array([tuple(r) for r in rows], float).reshape(len(rows), len(columns))


def _gram(df: DataFrame, columns, matrix, n_params: int, components: int, weighted: bool):
    """Sums over all data for the normal equations: partial matrices per partition, added pairwise in rounds.

    ``matrix(e, n)`` gives the rows of a batch. A partial result has p x p numbers, whatever the data's size.
    """
    p = n_params

    def partial(batches):
        gram, right, total, squares, n = np.zeros((p, p)), np.zeros(p), np.zeros(p), np.zeros(p), 0
        for b in batches:
            x = np.stack([np.asarray(c, dtype=float) for c in b.columns], 1)
            x = x[np.isfinite(x).all(1)]
            step = max(1, (1 << 22) // max(p, 1))
            for s in range(0, len(x), step):
                part = x[s : s + step]
                a = matrix(part[:, 0], part[:, 1])
                d = part[:, 2 : 2 + components].T.ravel()
                w = part[:, 2 + components :].T.ravel() if weighted else np.ones(len(d))
                gram += (a * w[:, None]).T @ a
                right += a.T @ (w * d)
                total += a.sum(0)
                squares += (a * a).sum(0)
                n += len(d)
        yield pa.RecordBatch.from_pydict({"part": [np.concatenate([gram.ravel(), right, total, squares, [n]]).tobytes()]}, schema=pa.schema([("part", pa.binary())]))

    def add(batches):
        out = None
        for b in batches:
            for v in b.column(0):
                x = np.frombuffer(v.as_py(), float)
                out = x.copy() if out is None else out + x
        if out is not None:
            yield pa.RecordBatch.from_pydict({"part": [out.tobytes()]}, schema=pa.schema([("part", pa.binary())]))

    parts = df.select(*columns).mapInArrow(partial, "part binary")
    # an exchange before each addition: the partial sums of all tasks are made first, then added in groups
    for width in (64, 8):
        parts = parts.repartition(width).mapInArrow(add, "part binary")
    sums = sum(np.frombuffer(r["part"], float) for r in parts.collect())
    k = p * p
    return sums[:k].reshape(p, p), sums[k : k + p], sums[k + p : k + 2 * p], sums[k + 2 * p : k + 3 * p], sums[-1]


def _predict(df: DataFrame, coords, names, kernel, forces: np.ndarray) -> DataFrame:
    """Append predictions: batches of rows against blocks of forces, forces shipped with the task (bounded)."""
    if len(forces) > MAX_FORCES * 2:
        raise ValueError(f"More than {MAX_FORCES} forces")
    schema = df.schema
    for name in names:
        schema = schema.add(name, "double") if name not in schema.names else schema
    keep = [c for c in df.columns if c not in names]
    order = [f for f in schema if f.name in keep] + [f for f in schema if f.name in names]
    from pyspark.sql import types as T

    schema = T.StructType(sorted(order, key=lambda f: (f.name in names, names.index(f.name) if f.name in names else 0)))

    def run(batches):
        for b in batches:
            e, n = (np.asarray(b.column(c).cast(pa.float64()), dtype=float) for c in ("__pe", "__pn"))
            out = kernel(e, n)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(v, pa.float64(), from_pandas=True) for v in out)], names=[*keep, *names])

    placed = df.select(*keep, F.col(coords[0]).cast("double").alias("__pe"), F.col(coords[1]).cast("double").alias("__pn"))
    return placed.mapInArrow(run, schema)


@dataclass(frozen=True)
class Spline(Gridder):
    """Biharmonic spline. Exact without damping (forces at the data); ridge with damping or own ``force_coords``.

    ``force_coords`` is an array (m, 2). Damped fits reduce all data to m x m sums on the executors.
    """

    mindist: float | None = None
    damping: float | None = None
    force_coords: np.ndarray | None = None
    engine: str = "auto"

    def fit(self, frame: SpatialFrame) -> FittedSpline:
        if len(frame.data) != 1:
            raise ValueError("A spline has one data component; use Vector for more")
        if frame.weights is not None and self.damping is None and self.force_coords is None:
            warnings.warn("Weights have no influence on an exact solution; give damping to use them", UserWarning, stacklevel=2)
        df = frame.clean()
        columns = [*frame.coords[:2], *frame.data, *(frame.weights or ())]
        clean = df.select(*columns).na.drop()
        mindist = self.mindist or 0.0
        if self.force_coords is None and self.damping is None and clean.limit(MAX_DENSE + 1).count() > MAX_DENSE:
            return _exact(clean, columns[:3], mindist, region_of(frame))
        if self.force_coords is None:
            rows = _bounded(clean, columns, MAX_EXACT, "A damped spline without own forces")
            at = rows[:, :2]
            matrix = biharmonic(rows[:, :1] - at[:, 0], rows[:, 1:2] - at[:, 1], mindist)
            force = None
            if self.damping is None:
                try:
                    force = np.linalg.solve(matrix, rows[:, 2])
                except np.linalg.LinAlgError:
                    force = None
                if force is not None and not np.allclose(matrix @ force, rows[:, 2], rtol=1e-6, atol=1e-6 * np.abs(rows[:, 2]).max(initial=1.0)):
                    force = None
            if force is None:
                force = least_squares(matrix, rows[:, 2], rows[:, 3] if frame.weights else None, self.damping)
        else:
            at = np.asarray(self.force_coords, float)
            fx, fy = at[:, 0], at[:, 1]
            gram, right, total, squares, n = _gram(clean, columns, lambda e, s: biharmonic(e[:, None] - fx, s[:, None] - fy, mindist), len(at), 1, frame.weights is not None)
            force = solve_gram(gram, right, column_scale(total, squares, n), self.damping)
        return FittedSpline(mindist=mindist, force_=force, force_coords_=at, region_=region_of(frame))


def _exact(df: DataFrame, columns, mindist: float, region) -> FittedSpline:
    """Many points: equal ones are one with their mean, as least squares have it; the driver holds a few numbers a point."""
    e, n, d = columns
    points = df.groupBy(e, n).agg(F.avg(d).alias("__d"))
    table = points.orderBy(e, n).toArrow()
    rows = np.stack([np.asarray(c.cast(pa.float64())) for c in table.columns], 1)
    rows = rows[np.isfinite(rows).all(1)]
    kernel = functools.partial(_many, mindist=mindist)
    force, sums = solve(rows[:, :2], rows[:, 2], kernel)
    return FittedSpline(mindist=mindist, force_=force, force_coords_=rows[:, :2], region_=region, sums_=sums)


@dataclass(frozen=True, kw_only=True)
class FittedSpline(FittedGridder):
    mindist: float
    force_: np.ndarray
    force_coords_: np.ndarray
    sums_: KernelSum | None = None

    def transform(self, df, coords=("easting", "northing"), names=None):
        at, force, mindist = self.force_coords_, self.force_, self.mindist
        if self.sums_ is not None or len(at) > MAX_FORCES:
            sums = self.sums_ or KernelSum(at, functools.partial(_many, mindist=mindist))
            v = force[sums.order]
            field = sums.field(v)
            sums = sums.light()
            return _predict(df, coords, self._names(names), lambda e, n: [sums.at(np.stack([e, n], 1), v, field)], at[:0])

        def kernel(e, n):
            out = np.zeros(len(e))
            step = max(1, (1 << 21) // max(len(e), 1))
            for s in range(0, len(at), step):
                out += biharmonic(e[:, None] - at[s : s + step, 0], n[:, None] - at[s : s + step, 1], mindist) @ force[s : s + step]
            return [out]

        return _predict(df, coords, self._names(names), kernel, at)

    def forces(self, spark) -> DataFrame:
        rows = [(k, float(e), float(n), float(f)) for k, ((e, n), f) in enumerate(zip(self.force_coords_, self.force_, strict=True))]
        return spark.createDataFrame(rows, "force_id int, easting double, northing double, force double")


def predict_by_join(points: DataFrame, forces: DataFrame, mindist: float, id_col="point_id", coords=("easting", "northing"), name="scalars") -> DataFrame:
    """Predictions as a broadcast join with a table of at most ``MAX_FORCES`` forces and a sum, all in generated code."""
    from gridspark.functions.columns import biharmonic as kernel

    if forces.limit(MAX_FORCES + 1).count() > MAX_FORCES:
        raise ValueError(f"More than {MAX_FORCES} forces")
    f = forces.select(F.col("easting").alias("__fe"), F.col("northing").alias("__fn"), F.col("force").alias("__f"))
    g = kernel(F.col(coords[0]) - F.col("__fe"), F.col(coords[1]) - F.col("__fn"), mindist)
    return points.select(id_col, *coords).crossJoin(F.broadcast(f)).groupBy(id_col).agg(F.sum(g * F.col("__f")).alias(name))


@dataclass(frozen=True)
class VectorSpline2D(Gridder):
    """Coupled spline of two components by two-dimensional elasticity."""

    poisson: float = 0.5
    mindist: float = 10e3
    damping: float | None = None
    force_coords: np.ndarray | None = None
    engine: str = "auto"

    def fit(self, frame: SpatialFrame) -> FittedVectorSpline2D:
        if len(frame.data) != 2:
            raise ValueError(f"Two data components are needed, not {len(frame.data)}")
        if frame.weights is not None and self.damping is None and self.force_coords is None:
            warnings.warn("Weights have no influence on an exact solution; give damping to use them", UserWarning, stacklevel=2)
        columns = [*frame.coords[:2], *frame.data, *(frame.weights or ())]
        clean = frame.clean().select(*columns).na.drop()
        if self.force_coords is None:
            rows = _bounded(clean, columns, MAX_EXACT // 2, "A vector spline with forces at the data")
            at = rows[:, :2]
            matrix = elastic(rows[:, :1] - at[:, 0], rows[:, 1:2] - at[:, 1], self.poisson, self.mindist)
            weights = rows[:, 4:].T.ravel() if frame.weights else None
            force = least_squares(matrix, rows[:, 2:4].T.ravel(), weights, self.damping)
        else:
            at = np.asarray(self.force_coords, float)
            fx, fy, v, m = at[:, 0], at[:, 1], self.poisson, self.mindist
            sums = _gram(clean, columns, lambda e, s: elastic(e[:, None] - fx, s[:, None] - fy, v, m), 2 * len(at), 2, frame.weights is not None)
            force = solve_gram(sums[0], sums[1], column_scale(*sums[2:]), self.damping)
        return FittedVectorSpline2D(poisson=self.poisson, mindist=self.mindist, force_=force, force_coords_=at, region_=region_of(frame), n_data=2)


@dataclass(frozen=True, kw_only=True)
class FittedVectorSpline2D(FittedGridder):
    poisson: float
    mindist: float
    force_: np.ndarray
    force_coords_: np.ndarray

    def transform(self, df, coords=("easting", "northing"), names=None):
        at, force, v, m = self.force_coords_, self.force_.reshape(2, -1), self.poisson, self.mindist

        def kernel(e, n):
            out = np.zeros((2, len(e)))
            step = max(1, (1 << 19) // max(len(e), 1))
            for s in range(0, len(at), step):
                k = elastic(e[:, None] - at[s : s + step, 0], n[:, None] - at[s : s + step, 1], v, m)
                out += (k @ force[:, s : s + step].ravel()).reshape(2, -1)
            return list(out)

        return _predict(df, coords, self._names(names), kernel, at)


@dataclass(frozen=True)
class SplineCV(Gridder):
    """A spline whose mindist and damping have the best mean cross-validation score; dampings vary fastest.

    ``delayed`` runs the splits of all candidates side by side, in ``threads`` threads of the driver, so that
    small fits share the cluster; scores and choice are the same.
    """

    mindists: tuple = (None,)
    dampings: tuple = (1e-10, 1e-5, 1e-1)
    force_coords: np.ndarray | None = None
    cv: object = None
    scoring: str | Callable | None = None
    delayed: bool = False
    threads: int = 8

    def fit(self, frame: SpatialFrame) -> FittedSplineCV:
        from gridspark.plans.selection import cross_val_score

        options = list(product(self.mindists or (None,), self.dampings))
        folds = [cross_val_score(Spline(m, d, self.force_coords), frame, cv=self.cv, scoring=self.scoring, delayed=self.delayed) for m, d in options]
        if self.delayed:
            with ThreadPool(self.threads) as pool:
                folds = self._side_by_side(pool, folds)
        scores = [float(np.mean(f)) for f in folds]
        mindist, damping = options[int(np.argmax(scores))]
        best = Spline(mindist, damping, self.force_coords).fit(frame)
        return FittedSplineCV(spline_=best, scores_=scores, mindist_=mindist, damping_=damping, region_=best.region_)

    @staticmethod
    def _side_by_side(pool, folds: list[list]) -> list[list[float]]:
        done = iter(pool.map(lambda job: job(), [job for jobs in folds for job in jobs]))
        return [[next(done) for _ in jobs] for jobs in folds]


@dataclass(frozen=True, kw_only=True)
class FittedSplineCV(FittedGridder):
    spline_: FittedSpline
    scores_: list
    mindist_: float | None
    damping_: float | None

    @property
    def force_(self):
        return self.spline_.force_

    @property
    def force_coords_(self):
        return self.spline_.force_coords_

    def transform(self, df, coords=("easting", "northing"), names=None):
        return self.spline_.transform(df, coords, names)
