"""Nearest-neighbour, linear and cubic interpolation."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators.geometry import MAX_TRIANGULATED, delaunay, delaunay_by_tiles
from gridspark.operators.neighbors import knn_join
from gridspark.plans.base import FittedGridder, Gridder, region_of
from gridspark.scratch import settle
from gridspark.spec import SpatialFrame

#: Least barycentric coordinate of a point that counts as inside.
_INSIDE = -1e-9


@dataclass(frozen=True)
class KNeighbors(Gridder):
    """The reduced value of the k nearest data; ``reduction`` is a name or a callable on a 2-D array with axis=1."""

    k: int = 1
    reduction: object = "mean"

    def fit(self, frame: SpatialFrame) -> FittedKNeighbors:
        if frame.weights is not None:
            warnings.warn("Nearest neighbours ignore weights", UserWarning, stacklevel=2)
        if len(frame.data) != 1:
            raise ValueError("One data component is needed; use Vector for more")
        e, n, d = *frame.coords[:2], frame.data[0]
        points = frame.clean().select(F.col(e).alias("easting"), F.col(n).alias("northing"), F.col(d).alias("value"))
        # equal points are told apart by their value: an id that doesn't depend on row order
        points = points.select(F.struct("easting", "northing", "value").alias("point_id"), "easting", "northing", "value")
        return FittedKNeighbors(k=self.k, reduction=self.reduction, points=points, region_=region_of(frame))


_REDUCE = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum}


@dataclass(frozen=True, kw_only=True)
class FittedKNeighbors(FittedGridder):
    k: int
    reduction: object
    points: DataFrame

    def transform(self, df, coords=("easting", "northing"), names=None):
        name = self._names(names)[0]
        e, n = (F.col(c).cast("double") for c in coords[:2])
        # queries are distinct places; rows meet their place's value again by an equi-join
        places = df.select(F.struct(e.alias("e"), n.alias("n")).alias("query_id")).distinct()
        places = places.select("query_id", F.col("query_id.e").alias("easting"), F.col("query_id.n").alias("northing"))
        near = knn_join(places, self.points, self.k).withColumn("value", F.col("point_id.value"))
        if callable(self.reduction):
            from pyspark.sql.functions import PandasUDFType, pandas_udf

            reduce = self.reduction

            def rows(values):
                import pandas as pd

                return pd.Series([float(np.ravel(reduce(np.asarray(v, float)[None], axis=1))[0]) for v in values])

            lists = near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("v"))
            found = lists.select("query_id", pandas_udf(rows, "double", PandasUDFType.SCALAR)(F.col("v.value")).alias("__v"))
        else:
            if self.reduction not in _REDUCE:
                raise ValueError(f"Unknown reduction {self.reduction!r}; known: {sorted(_REDUCE)}")
            found = near.groupBy("query_id").agg(_REDUCE[self.reduction]("value").alias("__v"))
        found = found.select(F.col("query_id.e").alias("__e"), F.col("query_id.n").alias("__n"), "__v")
        base = df.drop(name) if name in df.columns else df
        return base.join(found, (e == F.col("__e")) & (n == F.col("__n")), "left").drop("__e", "__n").withColumnRenamed("__v", name)


def _triangulated(frame: SpatialFrame, rescale: bool):
    if frame.weights is not None:
        warnings.warn("Interpolation ignores weights", UserWarning, stacklevel=3)
    if len(frame.data) != 1:
        raise ValueError("One data component is needed; use Vector for more")
    columns = [*frame.coords[:2], frame.data[0]]
    table = frame.clean().select(*columns).na.drop().dropDuplicates(columns[:2]).toArrow()
    rows = np.stack([np.asarray(c) for c in table.columns], 1)
    rows = rows[np.lexsort(rows.T[::-1])]
    shift, scale = np.zeros(2), np.ones(2)
    if rescale:
        shift, extent = rows[:, :2].min(0), np.ptp(rows[:, :2], axis=0)
        scale = np.where(extent > 0, extent, 1.0)
    points = (rows[:, :2] - shift) / scale
    triangles, near = delaunay(points) if len(points) <= MAX_TRIANGULATED else delaunay_by_tiles(frame.df.sparkSession, points)
    # slivers that doubles can't tell from a line hold no interior: without them, no division by their area
    a, b, c = (points[triangles[:, k]] for k in range(3))
    area = (b - a)[:, 0] * (c - a)[:, 1] - (c - a)[:, 0] * (b - a)[:, 1]
    size = np.maximum(np.maximum(((b - a) ** 2).sum(1), ((c - b) ** 2).sum(1)), ((a - c) ** 2).sum(1))
    solid = area > 1e-12 * size
    number = np.append(np.where(solid, np.cumsum(solid) - 1, -1), -1)
    triangles, near = triangles[solid], number[near[solid]]
    return points, rows[:, 2], triangles, near, shift, scale


@dataclass(frozen=True)
class Linear(Gridder):
    """Barycentric interpolation on a Delaunay triangulation; null outside the hull."""

    rescale: bool = False

    def fit(self, frame: SpatialFrame) -> FittedMesh:
        points, values, triangles, _, shift, scale = _triangulated(frame, self.rescale)
        return FittedMesh(points=points, triangles=triangles, coefficients=values[triangles], cubic=False, shift=shift, scale=scale, region_=region_of(frame))


@dataclass(frozen=True)
class Cubic(Gridder):
    """Clough-Tocher interpolation (piecewise cubic, continuous gradients); null outside the hull.

    Gradients minimise the curvature along all edges (Nielson 1983, Renka and Cline 1984); each triangle is
    split in three cubic Bezier patches (Alfeld 1984).
    """

    rescale: bool = False
    tolerance: float = 1e-6
    max_rounds: int = 400

    def fit(self, frame: SpatialFrame) -> FittedMesh:
        points, values, triangles, near, shift, scale = _triangulated(frame, self.rescale)
        gradients = (edge_gradients if len(points) <= MAX_TRIANGULATED else gradients_by_colours)(points, values, triangles, self.tolerance, self.max_rounds)
        return FittedMesh(points=points, triangles=triangles, coefficients=bezier_in_parts(points, values, gradients, triangles, near), cubic=True, shift=shift, scale=scale, region_=region_of(frame))


def edge_gradients(points, values, triangles, tolerance=1e-6, max_rounds=400) -> np.ndarray:
    """Gradients at the vertices: Gauss-Seidel rounds on the summed edge curvature, a 2 x 2 system a vertex."""
    edges = np.concatenate([triangles[:, [0, 1]], triangles[:, [1, 2]], triangles[:, [2, 0]]])
    edges = np.unique(np.sort(edges, 1), axis=0)
    edges = np.concatenate([edges, edges[:, ::-1]])
    edges = edges[np.argsort(edges[:, 0], kind="stable")]
    first = np.searchsorted(edges[:, 0], np.arange(len(points) + 1))
    g = np.zeros((len(points), 2))
    vectors = points[edges[:, 1]] - points[edges[:, 0]]
    cube = np.maximum(np.hypot(*vectors.T), 1e-300) ** 3
    outer = 4 * vectors[:, :, None] * vectors[:, None, :] / cube[:, None, None]
    used = np.flatnonzero(np.diff(first))
    systems = {i: np.linalg.pinv(outer[first[i] : first[i + 1]].sum(0)) for i in used.tolist()}
    rise = 6 * (values[edges[:, 1]] - values[edges[:, 0]])
    for _ in range(max_rounds):
        change = 0.0
        for i, inverse in systems.items():
            s = slice(first[i], first[i + 1])
            v = vectors[s]
            right = ((rise[s] - 2 * (g[edges[s, 1]] * v).sum(1)) / cube[s]) @ v
            new = inverse @ right
            change = max(change, np.abs(new - g[i]).max() / max(1.0, np.abs(new).max()))
            g[i] = new
        if change < tolerance:
            break
    return g


def gradients_by_colours(points, values, triangles, tolerance=1e-6, max_rounds=400) -> np.ndarray:
    """``edge_gradients`` of many points: vertices without a common edge have one colour and are updated at once."""
    n = len(points)
    edges = np.concatenate([triangles[:, [0, 1]], triangles[:, [1, 2]], triangles[:, [2, 0]]])
    key = np.unique(np.concatenate([edges[:, 0] * n + edges[:, 1], edges[:, 1] * n + edges[:, 0]]))
    a, b = key // n, key % n
    first = np.searchsorted(a, np.arange(n + 1))
    used = np.diff(first) > 0
    start = first[:-1][used]
    vectors = points[b] - points[a]
    cube = np.maximum(np.hypot(*vectors.T), 1e-300) ** 3
    systems = np.zeros((n, 2, 2))
    for i in (0, 1):
        for j in (0, 1):
            systems[used, i, j] = np.add.reduceat(4 * vectors[:, i] * vectors[:, j] / cube, start)
    inverse = np.linalg.pinv(systems)
    rise = 6 * (values[b] - values[a])
    rank = np.random.default_rng(0).permutation(n)
    open_, colours = used.copy(), []
    while open_.any():
        top = np.full(n, -1)
        top[used] = np.maximum.reduceat(np.where(open_[b], rank[b], -1), start)
        one = np.flatnonzero(open_ & (rank > top))
        open_[one] = False
        count = first[one + 1] - first[one]
        begin = np.cumsum(count) - count
        colours.append((one, np.arange(count.sum()) + np.repeat(first[one] - begin, count), begin))
    g = np.zeros((n, 2))
    for _ in range(max_rounds):
        change = 0.0
        for one, e, begin in colours:
            v = vectors[e]
            part = ((rise[e] - 2 * (g[b[e]] * v).sum(1)) / cube[e])[:, None] * v
            new = (inverse[one] @ np.add.reduceat(part, begin, 0)[:, :, None])[:, :, 0]
            change = max(change, float((np.abs(new - g[one]).max(1) / np.maximum(1.0, np.abs(new).max(1))).max()))
            g[one] = new
        if change < tolerance:
            break
    return g


def bezier_in_parts(points, values, gradients, triangles, near) -> np.ndarray:
    """``bezier`` by parts of the triangles, so that what it needs in between is bounded."""
    centroid = points[triangles].mean(1)
    out = np.zeros((len(triangles), 19))
    for s in range(0, len(triangles), 1 << 17):
        k = slice(s, s + (1 << 17))
        out[k] = bezier(points, values, gradients, triangles[k], near[k], centroid)
    return out


def bezier(points, values, gradients, triangles, near, centroids=None) -> np.ndarray:
    """The 19 coefficients of every triangle's three patches, in the order of ``_CUBIC_TERMS``."""
    out = np.zeros((len(triangles), 19))
    v, f, g = points[triangles], values[triangles], gradients[triangles]
    slope = lambda a, b: ((v[:, b] - v[:, a]) * g[:, a]).sum(1)
    c300, c030, c003 = f.T
    c210, c201 = c300 + slope(0, 1) / 3, c300 + slope(0, 2) / 3
    c120, c021 = c030 + slope(1, 0) / 3, c030 + slope(1, 2) / 3
    c102, c012 = c003 + slope(2, 0) / 3, c003 + slope(2, 1) / 3
    m1, m2, m3 = (c210 + c201 + c300) / 3, (c120 + c030 + c021) / 3, (c102 + c012 + c003) / 3
    # the cross-boundary derivative is linear along the line between centroids: affine invariant
    ratio = np.full((len(triangles), 3), -0.5)
    centroid = v.mean(1) if centroids is None else centroids
    side = np.stack([v[:, 1] - v[:, 0], v[:, 2] - v[:, 0]], 2)
    for k in range(3):
        has = near[:, k] >= 0
        if has.any():
            bc = np.linalg.solve(side[has], (centroid[near[has, k]] - v[has, 0])[:, :, None])[:, :, 0]
            b = np.stack([1 - bc.sum(1), bc[:, 0], bc[:, 1]], 1)
            p, q = b[:, (k + 1) % 3], b[:, (k + 2) % 3]
            ratio[has, k] = (2 * q + p - 1) / (2 - 3 * q - 3 * p)
    e1 = ratio[:, 0] * (-c030 + 3 * c021 - 3 * c012 + c003) + (-c030 + 2 * c021 - c012 + m3 + m2) / 2
    e2 = ratio[:, 1] * (-c003 + 3 * c102 - 3 * c201 + c300) + (-c003 + 2 * c102 - c201 + m1 + m3) / 2
    e3 = ratio[:, 2] * (-c300 + 3 * c210 - 3 * c120 + c030) + (-c300 + 2 * c210 - c120 + m1 + m2) / 2
    n1, n2, n3 = (e3 + e2 + m1) / 3, (e3 + e1 + m2) / 3, (e2 + e1 + m3) / 3
    out[:] = np.stack([c300, c210, c201, m1, c120, e3, c102, e2, n1, c030, c021, m2, c012, e1, n2, c003, m3, n3, (n1 + n2 + n3) / 3], 1)
    return out


#: (factor, powers of b1, b2, b3, b4) of every coefficient.
_CUBIC_TERMS = [
    (1, 3, 0, 0, 0), (3, 2, 1, 0, 0), (3, 2, 0, 1, 0), (3, 2, 0, 0, 1), (3, 1, 2, 0, 0), (6, 1, 1, 0, 1), (3, 1, 0, 2, 0), (6, 1, 0, 1, 1), (3, 1, 0, 0, 2),
    (1, 0, 3, 0, 0), (3, 0, 2, 1, 0), (3, 0, 2, 0, 1), (3, 0, 1, 2, 0), (6, 0, 1, 1, 1), (3, 0, 1, 0, 2), (1, 0, 0, 3, 0), (3, 0, 0, 2, 1), (3, 0, 0, 1, 2), (1, 0, 0, 0, 3),
]


@dataclass(frozen=True, kw_only=True)
class FittedMesh(FittedGridder):
    """Triangles with coefficients. Points meet triangles by cell, an equi-join; then barycentric columns decide."""

    points: np.ndarray
    triangles: np.ndarray
    coefficients: np.ndarray
    cubic: bool
    shift: np.ndarray
    scale: np.ndarray

    def _cells(self) -> tuple[float, float, float]:
        low, extent = self.points.min(0), np.ptp(self.points, axis=0)
        return float(low[0]), float(low[1]), float(max(extent.max(), 1e-300)) / max(1, int(len(self.triangles) ** 0.5))

    def tables(self, spark) -> tuple[DataFrame, DataFrame]:
        """(tri, x1..y3, cell), a row for every cell that a triangle's box touches, and (tri, coef)."""
        x0, y0, size = self._cells()
        v = self.points[self.triangles]
        low, high = np.floor((v.min(1) - (x0, y0)) / size).astype(np.int32), np.floor((v.max(1) - (x0, y0)) / size).astype(np.int32)
        tri = pa.array(np.arange(len(v), dtype=np.int32))
        columns = {"tri": tri, **{f"{c}{k + 1}": pa.array(np.ascontiguousarray(v[:, k, i])) for k in range(3) for i, c in enumerate("xy")}}
        columns |= {n: pa.array(np.ascontiguousarray(z)) for n, z in zip(("i0", "i1", "j0", "j1"), (low[:, 0], high[:, 0], low[:, 1], high[:, 1]), strict=True)}
        width = self.coefficients.shape[1]
        coef = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(self.coefficients).ravel()))
        shapes, coefs = spark.createDataFrame(pa.table(columns)), spark.createDataFrame(pa.table({"tri": tri, "coef": coef}))
        if len(v) > 2 * MAX_TRIANGULATED:
            shapes, coefs = settle(shapes), settle(coefs)
        return shapes.withColumn("cx", F.explode(F.sequence("i0", "i1"))).withColumn("cy", F.explode(F.sequence("j0", "j1"))).drop("i0", "i1", "j0", "j1"), coefs

    def transform(self, df, coords=("easting", "northing"), names=None):
        name = self._names(names)[0]
        x0, y0, size = self._cells()
        e, n = (F.col(c).cast("double") for c in coords[:2])
        x, y = (e - float(self.shift[0])) / float(self.scale[0]), (n - float(self.shift[1])) / float(self.scale[1])
        places = df.select(e.alias("__e"), n.alias("__n"), x.alias("__x"), y.alias("__y")).distinct()
        places = places.withColumns({"cx": F.floor((F.col("__x") - x0) / size).cast("int"), "cy": F.floor((F.col("__y") - y0) / size).cast("int")})
        shapes, coefs = self.tables(df.sparkSession)
        near = places.join(shapes, ["cx", "cy"])
        c = F.col
        det = (c("x2") - c("x1")) * (c("y3") - c("y1")) - (c("x3") - c("x1")) * (c("y2") - c("y1"))
        b2 = ((c("__x") - c("x1")) * (c("y3") - c("y1")) - (c("x3") - c("x1")) * (c("__y") - c("y1"))) / det
        b3 = ((c("x2") - c("x1")) * (c("__y") - c("y1")) - (c("__x") - c("x1")) * (c("y2") - c("y1"))) / det
        near = near.withColumns({"b2": b2, "b3": b3}).withColumn("b1", 1 - c("b2") - c("b3"))
        near = near.where(F.least("b1", "b2", "b3") >= _INSIDE)
        # a point on an edge is in several triangles: the first one counts
        near = near.groupBy("__e", "__n").agg(F.min_by(F.struct("tri", "b1", "b2", "b3"), "tri").alias("__t")).select("__e", "__n", "__t.*").join(coefs, "tri")
        if self.cubic:
            low = F.least("b1", "b2", "b3")
            near = near.withColumn("b4", 3 * low).withColumns({b: c(b) - low for b in ("b1", "b2", "b3")})
            value = F.lit(0.0)
            for k, (factor, *powers) in enumerate(_CUBIC_TERMS):
                term = F.lit(float(factor)) * F.get("coef", F.lit(k))
                for b, p in zip(("b1", "b2", "b3", "b4"), powers, strict=True):
                    for _ in range(p):
                        term = term * c(b)
                value = value + term
        else:
            value = sum((F.get("coef", F.lit(k)) * c(b) for k, b in enumerate(("b1", "b2", "b3"))), F.lit(0.0))
        found = near.select("__e", "__n", value.alias("__v"))
        base = df.drop(name) if name in df.columns else df
        return base.join(found, (e == c("__e")) & (n == c("__n")), "left").drop("__e", "__n").withColumnRenamed("__v", name)


class ScipyGridder(Gridder):
    """Deprecated facade over Linear, KNeighbors and Cubic."""

    def __init__(self, method: str = "cubic", extra_args: dict | None = None):
        warnings.warn("ScipyGridder is deprecated: use Linear, KNeighbors or Cubic", FutureWarning, stacklevel=2)
        self.method, self.extra_args = method, extra_args

    def fit(self, frame: SpatialFrame) -> FittedGridder:
        kinds = {"linear": Linear, "nearest": KNeighbors, "cubic": Cubic}
        if self.method not in kinds:
            raise ValueError(f"Invalid interpolation method {self.method!r}; known: {sorted(kinds)}")
        args = dict(self.extra_args or {})
        known = {"rescale"} if self.method != "nearest" else set()
        if unknown := sorted(set(args) - known):
            raise ValueError(f"{self.method!r} takes no {unknown}; known: {sorted(known)}")
        return kinds[self.method](**args).fit(frame)
