"""Convex hulls, masks, and Delaunay triangulation."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.operators.neighbors import within_distance
from gridspark.spec import GridFrame

#: Points that the driver triangulates at once; more are triangulated by tiles on the executors.
MAX_TRIANGULATED = 20_000
#: Points of a tile.
PER_TILE = 4_000


def _cross(o, a, b):
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def monotone_chain(points) -> list[tuple[float, float]]:
    """Hull vertices, counter-clockwise, without points on its edges."""
    points = sorted({(float(x), float(y)) for x, y in points})
    if len(points) < 3:
        return points

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and _cross(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def convex_hull(df: DataFrame, coords=("easting", "northing")) -> list[tuple[float, float]]:
    """Hull of all points: every partition reduces to its own hull, hulls meet by tree reduction to one task.

    What reaches the driver is the hull itself. Partial hulls are merged in groups, so no task takes
    more than a few of them.
    """
    schema = "e double, n double"

    def partial(batches):
        import pyarrow as pa

        hull: list = []
        for b in batches:
            xy = np.stack([np.asarray(b.column(0).drop_null()), np.asarray(b.column(1).drop_null())], 1)
            xy = xy[np.isfinite(xy).all(1)]
            for s in range(0, len(xy), 4096):
                hull = monotone_chain([*hull, *map(tuple, xy[s : s + 4096].tolist())])
        yield pa.RecordBatch.from_pydict({"e": [p[0] for p in hull], "n": [p[1] for p in hull]}, schema=pa.schema([("e", pa.float64()), ("n", pa.float64())]))

    points = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(coords, "en", strict=False)]).where("e IS NOT NULL AND n IS NOT NULL")
    hulls = points.mapInArrow(partial, schema)
    # an exchange before each merge: hulls are made where the points are, and only their corners move
    merged = hulls.repartition(16).mapInArrow(partial, schema).repartition(1).mapInArrow(partial, schema)
    return monotone_chain([(r["e"], r["n"]) for r in merged.collect()])


def in_hull(e: Column, n: Column, hull) -> Column:
    """Inside or on a hull: one half-plane per edge. Degenerate hulls are their segment or point."""
    if len(hull) == 0:
        return F.lit(False)
    xs, ys = [p[0] for p in hull], [p[1] for p in hull]
    size = max(max(xs) - min(xs), max(ys) - min(ys), 1e-300)
    eps = 1e-12 * size * size
    box = e.between(min(xs), max(xs)) & n.between(min(ys), max(ys))
    if len(hull) == 1:
        return box
    edges = list(zip(hull, [*hull[1:], hull[0]], strict=True))
    side = lambda a, b: F.lit(b[0] - a[0]) * (n - F.lit(a[1])) - F.lit(b[1] - a[1]) * (e - F.lit(a[0]))
    if len(hull) == 2:
        return box & (F.abs(side(*edges[0])) <= eps)
    # a long conjunction as one array keeps the expression tree flat
    return box & F.forall(F.array(*[side(a, b) for a, b in edges]), lambda v: v >= -eps)


def _projected(df: DataFrame, coords, projection):
    return (F.col(coords[0]).cast("double"), F.col(coords[1]).cast("double")) if projection is None else projection(F.col(coords[0]), F.col(coords[1]))


def convexhull_mask(points: DataFrame, coordinates: DataFrame | None = None, grid: GridFrame | None = None, projection=None, coords=("easting", "northing"), point_coords=("easting", "northing")):
    """``mask`` for rows of ``coordinates``, or ``grid`` with null outside the points' hull."""
    if coordinates is None and grid is None:
        raise ValueError("Give either coordinates or a grid")
    e, n = _projected(points, point_coords, projection)
    hull = convex_hull(points.select(e.alias("__e"), n.alias("__n")), ("__e", "__n"))
    if grid is not None:
        dims = grid.spec.dims
        return grid.where(in_hull(*_projected(grid.df, (dims[1], dims[0]), projection), hull))
    return coordinates.withColumn("mask", in_hull(*_projected(coordinates, coords, projection), hull))


def distance_mask(points: DataFrame, maxdist: float, coordinates: DataFrame | None = None, grid: GridFrame | None = None, projection=None, keys=("point_id",), coords=("easting", "northing"), point_coords=("easting", "northing")):
    """``mask`` for rows of ``coordinates`` (identified by ``keys``), or ``grid`` with null farther than ``maxdist``."""
    if coordinates is None and grid is None:
        raise ValueError("Give either coordinates or a grid")
    pe, pn = _projected(points, point_coords, projection)
    spots = points.select(pe.alias("__pe0"), pn.alias("__pn0"))
    if grid is not None:
        coordinates, keys, coords = grid.df, ("row", "col"), (grid.spec.dims[1], grid.spec.dims[0])
    e, n = _projected(coordinates, coords, projection)
    targets = coordinates.withColumns({"__te": e, "__tn": n})
    masked = within_distance(targets, spots, maxdist, keys, ("__te", "__tn"), ("__pe0", "__pn0")).drop("__te", "__tn")
    return grid.where(F.col("mask"), masked) if grid is not None else masked


# --- Delaunay triangulation -------------------------------------------------------------------


def _orient(a, b, c) -> int:
    """Sign of the turn a, b, c; exact where doubles can't tell."""
    left, right = (b[0] - a[0]) * (c[1] - a[1]), (b[1] - a[1]) * (c[0] - a[0])
    d = left - right
    if abs(d) > 1e-12 * (abs(left) + abs(right)):
        return 1 if d > 0 else -1
    ax, ay, bx, by, cx, cy = (Fraction(v) for v in (*a, *b, *c))
    d = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (d > 0) - (d < 0)


def _in_circle(a, b, c, d) -> bool:
    """Is d strictly inside the circle through a, b, c (counter-clockwise)?"""
    return _circle(a, b, c, d) > 0


def _in_circle_of_few(a, b, c, d) -> bool:
    """The same where no four points are on one circle: the last of them counts as lifted a trace off it."""
    side = _circle(a, b, c, d)
    if side:
        return side > 0
    top = max(a, b, c, d)
    if top == d:
        return False
    return _orient(*(d if p == top else p for p in (a, b, c))) > 0


def _circle(a, b, c, d) -> int:
    rows = [(p[0] - d[0], p[1] - d[1]) for p in (a, b, c)]
    sq = [x * x + y * y for x, y in rows]
    (ax, ay), (bx, by), (cx, cy) = rows
    t = (ax * by * sq[2], -ax * cy * sq[1], -bx * ay * sq[2], bx * cy * sq[0], cx * ay * sq[1], -cx * by * sq[0])
    det = sum(t)
    if abs(det) > 1e-11 * sum(map(abs, t)):
        return 1 if det > 0 else -1
    dx, dy = Fraction(d[0]), Fraction(d[1])
    rows = [(Fraction(p[0]) - dx, Fraction(p[1]) - dy) for p in (a, b, c)]
    sq = [x * x + y * y for x, y in rows]
    (ax, ay), (bx, by), (cx, cy) = rows
    det = ax * (by * sq[2] - cy * sq[1]) - bx * (ay * sq[2] - cy * sq[0]) + cx * (ay * sq[1] - by * sq[0])
    return (det > 0) - (det < 0)


def delaunay(points: np.ndarray, unique: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(triangles, neighbours): counter-clockwise vertex triples and, opposite each vertex, the next triangle or -1.

    Incremental insertion (Bowyer 1981, Watson 1981) in Hilbert-like order with a walk from the last
    triangle; outside edges belong to ghost triangles with a vertex at infinity, so hulls are exact.
    Of equal points only the first is used. With ``unique`` points on one circle are told apart by their
    coordinates, so that triangulations of parts agree.
    """
    in_circle = _in_circle_of_few if unique else _in_circle
    xy = [tuple(map(float, p)) for p in points]
    first: dict = {}
    for i, p in enumerate(xy):
        first.setdefault(p, i)
    order = list(first.values())
    if len(order) < 3:
        raise ValueError("A triangulation needs three different points")
    arr = np.array([xy[i] for i in order])
    cell = np.maximum(np.ptp(arr, axis=0).max(), 1e-300) / max(1, int(len(arr) ** 0.5 / 2))
    gy = np.floor((arr[:, 1] - arr[:, 1].min()) / cell)
    snake = np.where(gy % 2 == 0, arr[:, 0], -arr[:, 0])
    order = [order[k] for k in np.lexsort((snake, gy))]
    a = order[0]
    b = next(i for i in order if xy[i] != xy[a])
    c = next((i for i in order if _orient(xy[a], xy[b], xy[i]) != 0), None)
    if c is None:
        raise ValueError("All points lie on one line")
    if _orient(xy[a], xy[b], xy[c]) < 0:
        b, c = c, b
    ghost = -1
    faces: dict[int, tuple] = {}
    edge: dict[tuple[int, int], int] = {}
    count = 0

    def add(u, v, w):
        nonlocal count
        faces[count] = (u, v, w)
        edge[u, v] = edge[v, w] = edge[w, u] = count
        count += 1
        return count - 1

    last = add(a, b, c)
    for u, v in ((b, a), (c, b), (a, c)):
        add(u, v, ghost)

    def conflict(f, p):
        u, v, w = faces[f]
        if ghost in (u, v, w):
            while w != ghost:
                u, v, w = v, w, u
            o = _orient(xy[u], xy[v], p)
            if o != 0:
                return o > 0
            # on the hull's line: inside the edge itself
            return min(xy[u], xy[v]) < p < max(xy[u], xy[v])
        return in_circle(xy[u], xy[v], xy[w], p)

    done = {a, b, c}
    for i in order:
        if i in done:
            continue
        p = xy[i]
        f, steps = last, 0
        while True:  # walk towards p
            u, v, w = faces[f]
            if ghost in (u, v, w):
                break
            steps += 1
            sides = ((u, v), (v, w), (w, u))
            for s in range(3):
                x, y = sides[(s + steps) % 3]
                if _orient(xy[x], xy[y], p) < 0:
                    f = edge[y, x]
                    break
            else:
                break
        if not conflict(f, p):
            f = next(g for g in faces if conflict(g, p))
        bad, stack = {f}, [f]
        while stack:
            u, v, w = faces[stack.pop()]
            for x, y in ((u, v), (v, w), (w, u)):
                g = edge[y, x]
                if g not in bad and conflict(g, p):
                    bad.add(g)
                    stack.append(g)
        rim = [(x, y) for g in bad for u, v, w in (faces[g],) for x, y in ((u, v), (v, w), (w, u)) if edge[y, x] not in bad]
        for g in bad:
            del faces[g]
        for x, y in rim:
            g = add(x, y, i)
            if ghost not in (x, y):
                last = g
    real = [f for f in faces.values() if ghost not in f]
    number = {f: k for k, f in enumerate(real)}
    owner = {e: number.get(faces[g], -1) for e, g in edge.items() if g in faces}
    near = [[owner.get((w, v), -1), owner.get((u, w), -1), owner.get((v, u), -1)] for u, v, w in real]
    return np.array(real, np.int64), np.array(near, np.int64)


def _neighbours(triangles: np.ndarray) -> np.ndarray:
    """Opposite each vertex, the next triangle or -1."""
    n = int(triangles.max(initial=0)) + 1
    u, v = np.roll(triangles, -1, 1).ravel(), np.roll(triangles, -2, 1).ravel()
    key, twin = u * n + v, v * n + u
    order = np.argsort(key)
    at = np.minimum(np.searchsorted(key[order], twin), len(key) - 1)
    return np.where(key[order][at] == twin, order[at] // 3, -1).reshape(-1, 3)


def _certain(points: np.ndarray, own, known) -> np.ndarray:
    """Triangles with their middle in the box ``own`` whose circles lie in ``known``, where all points are given."""
    try:
        triangles, _ = delaunay(points, unique=True)
    except ValueError:  # too few points, or all on one line
        return np.zeros((0, 3), np.int64)
    a, b, c = (points[triangles[:, k]] for k in range(3))
    p, q = b - a, c - a
    area = p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]
    pp, qq = (p * p).sum(1), (q * q).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        center = np.stack([q[:, 1] * pp - p[:, 1] * qq, p[:, 0] * qq - q[:, 0] * pp], 1) / (2 * area[:, None])
    radius = np.hypot(*center.T) * (1 + 1e-6)
    # circles of slivers are not exact enough
    fine = area > 1e-8 * np.maximum(pp, qq)
    fine &= ((a + center - radius[:, None] > known[0]) & (a + center + radius[:, None] < known[1])).all(1)
    triangles = triangles[fine]
    triangles = triangles[np.arange(len(triangles))[:, None], (triangles.argmin(1)[:, None] + np.arange(3)) % 3]
    middle = points[triangles].mean(1)
    return triangles[((middle >= own[0]) & (middle < own[1])).all(1)]


def delaunay_by_tiles(spark, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``delaunay`` of many different points, sorted by their coordinates.

    Tiles of about equal numbers of points are triangulated by tasks, each with the points around it. A triangle whose
    circle lies in what its tile knows is one of the whole triangulation. All others have their vertices
    among those that are not surrounded by such triangles: few, whose triangulation fills the gaps.
    """
    n = len(points)
    if n <= MAX_TRIANGULATED:
        return delaunay(points, unique=True)
    tiles, stack = [], [(np.arange(n), np.full(2, -np.inf), np.full(2, np.inf))]
    while stack:
        k, low, high = stack.pop()
        if len(k) > PER_TILE:
            axis = int(np.argmax(np.ptp(points[k], axis=0)))
            cut = np.median(points[k, axis])
            left = points[k, axis] < cut
            if left.any():
                for part, side, ends in ((k[left], 1, high), (k[~left], 0, low)):
                    ends = ends.copy()
                    ends[axis] = cut
                    stack.append((part, *((low, ends) if side else (ends, high))))
                continue
        around = np.ptp(points[k], axis=0).max() * 0.3
        # beyond a tile's own points there may be nothing: it needs no wider view there
        known = np.maximum(low, points[k].min(0)) - around, np.minimum(high, points[k].max(0)) + around
        near = np.flatnonzero(((points >= known[0]) & (points <= known[1])).all(1))
        tiles.append((near.astype(np.int64).tobytes(), points[near].tobytes(), np.stack([low, high, *known]).tobytes()))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for near, xy, boxes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                near, xy, boxes = np.frombuffer(near, np.int64), np.frombuffer(xy).reshape(-1, 2), np.frombuffer(boxes).reshape(4, 2)
                yield pa.RecordBatch.from_pydict({"t": [near[_certain(xy, boxes[:2], boxes[2:])].tobytes()]}, schema=pa.schema([("t", pa.binary())]))

    df = spark.createDataFrame(tiles, "near binary, xy binary, boxes binary").repartition(len(tiles))
    parts = [np.frombuffer(r["t"], np.int64).reshape(-1, 3) for r in df.mapInArrow(run, "t binary").toLocalIterator()]
    sure = np.concatenate(parts)
    sure = sure[np.lexsort(sure.T[::-1])]
    rim = _neighbours(sure) < 0 if len(sure) else np.zeros((0, 3), bool)
    u, v = np.roll(sure, -1, 1)[rim], np.roll(sure, -2, 1)[rim]
    alone = np.ones(n, bool)
    alone[sure.ravel()] = False
    alone[u] = alone[v] = True
    rest = np.flatnonzero(alone)
    more, near = delaunay_by_tiles(spark, points[rest]) if len(rest) <= 0.7 * n else delaunay(points[rest], unique=True)
    more = rest[more]
    # the gaps: what is reached from the other sides of rims without crossing one
    key = (np.roll(more, -1, 1) * n + np.roll(more, -2, 1)).ravel()
    at_rim = np.isin(key, v * n + u).reshape(-1, 3)
    inside = at_rim.any(1) if len(sure) else np.ones(len(more), bool)
    fresh = np.flatnonzero(inside)
    while len(fresh):
        step = near[fresh][~at_rim[fresh]]
        step = np.unique(step[step >= 0])
        fresh = step[~inside[step]]
        inside[fresh] = True
    triangles = np.concatenate([sure, more[inside]])
    triangles = triangles[np.arange(len(triangles))[:, None], (triangles.argmin(1)[:, None] + np.arange(3)) % 3]
    triangles = triangles[np.lexsort(triangles.T[::-1])]
    return triangles, _neighbours(triangles)
