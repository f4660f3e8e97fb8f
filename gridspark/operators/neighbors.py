"""Nearest neighbours by multi-resolution cells, distance masks, median distances."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.scratch import settle
from gridspark.spec import get_region

#: The finest cells hold about this many data points on average.
PER_CELL = 4
#: Candidates that one task ranks on average.
PER_TASK = 250_000
#: Tasks of a later round at most; ten times as many in the first.
MAX_TASKS = 1000


def _cells(x: str, size: float, ring: int = 0) -> Column:
    cell = F.floor(F.col(x) / F.lit(size)).cast("long")
    return F.sequence(cell - ring, cell + ring) if ring else cell


def knn_join(queries: DataFrame, points: DataFrame, k: int = 1, query_id: str = "query_id", point_id: str = "point_id", query_coords=("easting", "northing"), point_coords=("easting", "northing")) -> DataFrame:
    """(query_id, rank, point_id, distance): the k nearest points of every query, ties by smaller id.

    Queries look into the 3 x 3 cells around them, an equi-join; who finds k points no farther than
    one cell width is done, for no point outside can be nearer. The others go on with cells of
    twice the width. A round touches only the queries still open, and the number of rounds is the
    logarithm of how far the farthest query lies. Fewer than k points give fewer rows.
    """
    if k < 1:
        raise ValueError(f"k is one at least, not {k}")
    q = queries.select(F.col(query_id).alias("__q"), *[F.col(c).cast("double").alias(n) for c, n in zip(query_coords, ("__qe", "__qn"), strict=False)]).where("__qe IS NOT NULL AND __qn IS NOT NULL")
    p = points.select(F.col(point_id).alias("__p"), *[F.col(c).cast("double").alias(n) for c, n in zip(point_coords, ("__pe", "__pn"), strict=False)]).where("__pe IS NOT NULL AND __pn IS NOT NULL")
    n = p.count()
    spark = p.sparkSession
    schema = f"{query_id} {queries.schema[query_id].dataType.simpleString()}, rank int, {point_id} {points.schema[point_id].dataType.simpleString()}, distance double"
    if n == 0:
        return spark.createDataFrame([], schema)
    w, e, s, north = get_region(p, ("__pe", "__pn"))
    extent = max(e - w, north - s)
    size = math.sqrt(max((e - w) * (north - s), (extent * 1e-3) ** 2) * max(PER_CELL, k) / n) or 1.0
    out, open_, asked, wider = None, settle(q), None, 1
    while True:
        asked = open_.count() if asked is None else asked
        # candidates to expect, four times as many a query with every round
        parts = max(1, min(math.ceil(asked * min(9 * max(PER_CELL, k) * wider**2, n) / PER_TASK), 10 * MAX_TASKS if wider == 1 else MAX_TASKS))
        # the smaller side goes to all 3 x 3 cells; queries that stay in theirs are ranked where they meet the points
        still = asked * 4 > n
        data, near = p.select("__p", "__pe", "__pn"), open_.select("__q", "__qe", "__qn")
        data = data.withColumn("__x", F.explode(_cells("__pe", size, 1))).withColumn("__y", F.explode(_cells("__pn", size, 1))) if still else data.withColumns({"__x": _cells("__pe", size), "__y": _cells("__pn", size)})
        near = near.withColumns({"__x": _cells("__qe", size), "__y": _cells("__qn", size)}) if still else near.withColumn("__x", F.explode(_cells("__qe", size, 1))).withColumn("__y", F.explode(_cells("__qn", size, 1)))
        if still:
            data, near = data.repartition(parts, "__x", "__y"), near.repartition(parts, "__x", "__y")
        d = F.hypot(F.col("__pe") - F.col("__qe"), F.col("__pn") - F.col("__qn"))
        found = near.join(data.hint("merge") if still else data, ["__x", "__y"]).select("__x", "__y", "__q", "__p", d.alias("__d"))
        if not still:
            found = found.repartition(parts, "__q")
        of = ["__x", "__y", "__q"] if still else ["__q"]
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*of).orderBy("__d", "__p"))).where(F.col("rank") <= k).drop("__x", "__y")
        # a point at exactly one cell width may have an equal outside the cells
        last = size > 2 * _farthest(open_, (w, e, s, north))
        sure = settle(ranked.where(F.lit(last)) if last else ranked.where(F.col("__d") < size))
        done = sure.groupBy("__q").agg(F.count("*").alias("n")).where(F.col("n") >= (0 if last else k)).select("__q")
        rows = sure.join(done, "__q", "left_semi")
        out = rows if out is None else out.unionByName(rows)
        if last:
            break
        open_ = settle(open_.join(done, "__q", "left_anti"))
        asked = open_.count()
        if not asked:
            break
        size, wider = size * 2, wider * 2
    return out.select(F.col("__q").alias(query_id), F.col("rank").cast("int").alias("rank"), F.col("__p").alias(point_id), F.col("__d").alias("distance"))


def _farthest(queries: DataFrame, box) -> float:
    """Bound of the distance between any open query and any point: the diagonal of both boxes together."""
    w, e, s, n = box
    r = queries.agg(F.min("__qe"), F.max("__qe"), F.min("__qn"), F.max("__qn")).first()
    if r[0] is None:
        return 0.0
    return math.hypot(max(e, r[1]) - min(w, r[0]), max(n, r[3]) - min(s, r[2]))


def median_distance(df: DataFrame, k_nearest: int = 1, id_col: str = "point_id", coords=("easting", "northing"), projection=None) -> DataFrame:
    """(id, median_distance) to the k nearest other points; the point itself, first by (distance, id), is left out.

    A duplicate of a point may be left out in its place: its distance is 0 as well.
    """
    points = df.select(F.col(id_col), *[F.col(c).cast("double").alias(c) for c in coords[:2]])
    if projection is not None:
        e, n = projection(F.col(coords[0]), F.col(coords[1]))
        points = points.select(id_col, e.alias(coords[0]), n.alias(coords[1]))
    pairs = knn_join(points.withColumnRenamed(id_col, "__of"), points, k_nearest + 1, "__of", id_col, coords, coords)
    return pairs.where("rank > 1").groupBy(F.col("__of").alias(id_col)).agg(F.median("distance").alias("median_distance"))


def within_distance(targets: DataFrame, points: DataFrame, maxdist: float, keys, target_coords=("easting", "northing"), point_coords=("easting", "northing")) -> DataFrame:
    """``targets`` with ``mask``: is a point no farther than ``maxdist``?

    A cell whose diagonal is ``maxdist`` decides for all its targets when it holds a point, and only whether
    it does is joined. Targets in cells without one, the rim and the empty space, meet the distinct positions
    of points in wider cells around them: an equi-join that crowded cells take no part in but for their rim.
    """
    if maxdist <= 0:
        raise ValueError(f"maxdist is positive, not {maxdist}")
    reach = float(maxdist)
    spots = points.select(*[F.col(c).cast("double").alias(n) for c, n in zip(point_coords, ("__pe", "__pn"), strict=False)]).where("__pe IS NOT NULL AND __pn IS NOT NULL").distinct()
    spots = spots.withColumn("__x", F.explode(_cells("__pe", reach, 1))).withColumn("__y", F.explode(_cells("__pn", reach, 1)))
    asked = targets.select(*keys, *[F.col(c).cast("double").alias(n) for c, n in zip(target_coords, ("__qe", "__qn"), strict=False)])
    inner = reach * math.sqrt(0.5) * (1 - 1e-12)
    full = points.select(_cells(point_coords[0], inner).alias("__fx"), _cells(point_coords[1], inner).alias("__fy")).distinct().withColumn("__full", F.lit(True))
    asked = asked.withColumns({"__fx": _cells("__qe", inner), "__fy": _cells("__qn", inner)}).join(full, ["__fx", "__fy"], "left").drop("__fx", "__fy")
    sure = asked.where("__full").select(*keys)
    asked = asked.where("__full IS NULL").withColumns({"__x": _cells("__qe", reach), "__y": _cells("__qn", reach)})
    hit = F.hypot(F.col("__pe") - F.col("__qe"), F.col("__pn") - F.col("__qn")) <= reach
    hits = asked.join(spots, ["__x", "__y"]).where(hit).select(*keys).unionByName(sure).distinct().withColumn("__hit", F.lit(True))
    return targets.join(hits, list(keys), "left").withColumn("mask", F.coalesce("__hit", F.lit(False))).drop("__hit")
