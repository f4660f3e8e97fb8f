"""Registered queries over the test tables, with the DuckDB SQL that gives the same rows.

Roles: events are points (user_id, value) with datum event_id; lineitem are points (l_quantity,
100 l_discount) with datum l_extendedprice and weight 1 + l_tax; customers and suppliers are two point
sets; embeddings' first three components are a continuous scatter.
"""

from __future__ import annotations

import io
import math
import warnings

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.columns import biharmonic, inside, longitude_region, mercator, wrap_longitude
from gridspark.operators.blocks import block_mean, block_reduce, block_split, maxabs, minmax, variance_to_weights
from gridspark.operators.geometry import convexhull_mask, distance_mask
from gridspark.operators.neighbors import knn_join, median_distance
from gridspark.operators.windows import expanding_window, rolling_window, window_lists
from gridspark.plans.compose import BlockMean, BlockReduce, Chain, Vector
from gridspark.plans.interpolators import Cubic, KNeighbors, Linear
from gridspark.plans.projections import project_coordinates, project_grid, project_region
from gridspark.plans.selection import BlockKFold, BlockShuffleSplit, KFold, cross_val_score, equal_folds, partition_by_sum, random_split, train_test_split
from gridspark.plans.splines import FittedSpline, FittedVectorSpline2D, Spline, SplineCV, VectorSpline2D, predict_by_join
from gridspark.plans.trend import CheckerBoard, Trend
from gridspark.sources.surfer import SurferSource, load_surfer
from gridspark.spec import GridSpec, SpatialFrame, check_meshgrid, get_region, line_coordinates, make_grid, meshgrid_to_1d, pad_region, profile_coordinates, scatter_points, shape_to_spacing, spacing_to_size
from gridspark.streaming.blocks import block_counts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir) -> SpatialFrame:
    df = _table(spark, sf_dir, "events").select(F.col("event_id").alias("point_id"), F.col("user_id").cast("double").alias("easting"), F.col("value").alias("northing"), F.col("event_id").cast("double").alias("scalars"))
    return SpatialFrame(df)


def _items(spark, sf_dir, weighted=True) -> SpatialFrame:
    df = _table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("easting"), (F.col("l_discount") * 100).alias("northing"), F.col("l_extendedprice").alias("scalars"), (1 + F.col("l_tax")).alias("weight"))
    return SpatialFrame(df, weights=("weight",) if weighted else None)


def _scatter(spark, sf_dir) -> SpatialFrame:
    x = lambda k: F.get("embedding", F.lit(k)).cast("double")
    df = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), x(0).alias("easting"), x(1).alias("northing"), x(2).alias("scalars"))
    return SpatialFrame(df)


def _rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


_E = "SELECT event_id AS point_id, CAST(user_id AS DOUBLE) AS e, value AS n, CAST(event_id AS DOUBLE) AS z FROM events"
_L = "SELECT l_quantity AS e, l_discount * 100 AS n, l_extendedprice AS z, 1 + l_tax AS w FROM lineitem"
_BOX = "SELECT min(e) AS w0, max(e) AS e0, min(n) AS s0, max(n) AS n0 FROM p"


def _labelled(points: str, ny: int, nx: int, region: str | None = None) -> str:
    """Points with block labels; the data's own region unless four numbers are given."""
    box = _BOX if region is None else f"SELECT {region}"
    cell = lambda x, a, z, k: f"least(greatest(CAST(floor(({x} - {a}) / (({z} - {a}) / {k})) AS BIGINT), 0), {k - 1})"
    return f"p AS ({points}), box AS ({box}), b AS (SELECT p.*, CAST({cell('n', 's0', 'n0', ny)} * {nx} + {cell('e', 'w0', 'e0', nx)} AS BIGINT) AS block FROM p, box)"


# --- coordinates ---------------------------------------------------------------------------------


@query("SELECT CAST(i AS INTEGER) AS col, CASE WHEN i = 10 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE + i * 1.0::DOUBLE END AS easting FROM range(11) t(i)")
def line_coordinates_axis(spark, sf_dir):
    return GridSpec.make((0, 10, 0, 1), shape=(2, 11)).axis(spark, "easting")


@query("SELECT CAST(i AS INTEGER) AS i, round(0.5::DOUBLE + i, 9) AS x FROM range(10) t(i)")
def line_coordinates_pixel(spark, sf_dir):
    nodes = line_coordinates(0, 10, spacing=1, pixel_register=True)
    return spark.createDataFrame([(i, round(float(x), 9)) for i, x in enumerate(nodes)], "i int, x double")


@query("""SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, round(CASE WHEN r = 40 THEN 500.0 ELSE r * 12.5 END::DOUBLE, 9) AS northing,
  round(CASE WHEN c = 30 THEN 150.0 ELSE c * 5.0 END::DOUBLE, 9) AS easting, 7.0::DOUBLE AS extra_coord FROM range(41) a(r), range(31) b(c)""")
def grid_coordinates(spark, sf_dir):
    return _rounded(GridSpec.make((0, 150, 0, 500), shape=(41, 31), extra_coords=7).to_df(spark), {"northing": 9, "easting": 9})


@query("""SELECT * FROM (VALUES (0.0, 10.0, 2.5, 5, 10.0), (0.0, 10.0, 4.0, 3, 10.0), (0.0, 10.0, 30.0, 2, 10.0), (-5.0, 0.0, 2.0, 3, 0.0)) t(a, z, step, size, stop)""".replace("(VALUES", "(SELECT CAST(a AS DOUBLE) AS a, CAST(z AS DOUBLE) AS z, CAST(step AS DOUBLE) AS step, CAST(size AS INTEGER) AS size, CAST(stop AS DOUBLE) AS stop FROM (VALUES").replace("t(a,", "v(a,") + ") t")
def spacing_to_size_cases(spark, sf_dir):
    cases = [(0.0, 10.0, 2.5), (0.0, 10.0, 4.0), (0.0, 10.0, 30.0), (-5.0, 0.0, 2.0)]
    return spark.createDataFrame([(*c, *spacing_to_size(*c)) for c in cases], "a double, z double, step double, size int, stop double")


@query("SELECT (max(value) - min(value)) / 9 AS north, (max(CAST(user_id AS DOUBLE)) - min(user_id)) / 4 AS east FROM events")
def shape_to_spacing_events(spark, sf_dir):
    north, east = shape_to_spacing(get_region(_events(spark, sf_dir).df), (10, 5))
    return spark.createDataFrame([(north, east)], "north double, east double")


@query("SELECT CAST(min(user_id) AS DOUBLE) AS west, CAST(max(user_id) AS DOUBLE) AS east, min(value) AS south, max(value) AS north FROM events")
def get_region_events(spark, sf_dir):
    return spark.createDataFrame([get_region(_events(spark, sf_dir).df)], "west double, east double, south double, north double")


@query("SELECT min(CAST(user_id AS DOUBLE)) - 3.0::DOUBLE AS west, max(CAST(user_id AS DOUBLE)) + 3.0::DOUBLE AS east, min(value) - 2.0::DOUBLE AS south, max(value) + 2.0::DOUBLE AS north FROM events")
def pad_region_events(spark, sf_dir):
    return spark.createDataFrame([pad_region(get_region(_events(spark, sf_dir).df), (2, 3))], "west double, east double, south double, north double")


@query("SELECT CAST(i AS INTEGER) AS idx, round(1 + i * 3 / 20.0::DOUBLE, 9) AS easting, round(2 + i * 4 / 20.0::DOUBLE, 9) AS northing, round(i * 5 / 20.0::DOUBLE, 9) AS distance FROM range(21) t(i)")
def profile_coordinates_line(spark, sf_dir):
    return _rounded(profile_coordinates(spark, (1, 2), (4, 6), 21), {"easting": 9, "northing": 9, "distance": 9})


def _draws(n=50, seed=4, region=(0.0, 150.0, 0.0, 500.0)):
    rng = np.random.RandomState(seed)
    w, e, s, north = region
    return list(zip(range(n), rng.uniform(w, e, n).tolist(), rng.uniform(s, north, n).tolist(), strict=True))


def _values(rows, columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows) + f") t({columns})"


@query(f"SELECT CAST(k AS BIGINT) AS point_id, round(x, 9) AS easting, round(y, 9) AS northing FROM {_values(_draws(), 'k, x, y')}")
def scatter_points_seeded(spark, sf_dir):
    return _rounded(scatter_points(spark, (0, 150, 0, 500), 50, 4), {"easting": 9, "northing": 9})


@query("SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, r * 12.5::DOUBLE AS northing, c * 5.0::DOUBLE AS easting, n FROM range(5) a(r), range(4) b(c), (SELECT count(*) AS n FROM events)")
def make_grid_constant(spark, sf_dir):
    spec = GridSpec.make((0, 15, 0, 50), shape=(5, 4))
    n = _table(spark, sf_dir, "events").agg(F.count("*").alias("n"))
    values = spec.to_df(spark).select("row", "col").crossJoin(F.broadcast(n))
    return make_grid(spec, values).df


@query("SELECT r * 12.5::DOUBLE AS northing, c * 5.0::DOUBLE AS easting, CAST(r * 4 + c AS DOUBLE) AS scalars FROM range(5) a(r), range(4) b(c)")
def grid_to_table(spark, sf_dir):
    spec = GridSpec.make((0, 15, 0, 50), shape=(5, 4))
    return make_grid(spec, spec.to_df(spark).select("row", "col", (F.col("row") * 4 + F.col("col")).cast("double").alias("scalars"))).to_table()


@query("SELECT CAST(c AS INTEGER) AS col, c * 5.0::DOUBLE AS easting FROM range(4) b(c)")
def meshgrid_to_axes(spark, sf_dir):
    lattice = GridSpec.make((0, 15, 0, 50), shape=(5, 4)).to_df(spark)
    check_meshgrid(lattice)
    return meshgrid_to_1d(lattice)[0]


# --- predicates and projections --------------------------------------------------------------------


@query("SELECT event_id, (user_id BETWEEN 20 AND 90) AND (value BETWEEN 50 AND 300) AS inside FROM events")
def inside_region(spark, sf_dir):
    df = _table(spark, sf_dir, "events")
    return df.select("event_id", inside(F.col("user_id").cast("double"), F.col("value"), (20, 90, 50, 300)).alias("inside"))


@query("SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE user_id BETWEEN 20 AND 90 AND value BETWEEN 50 AND 300")
def inside_filter(spark, sf_dir):
    df = _table(spark, sf_dir, "events")
    return df.where(inside(F.col("user_id"), F.col("value"), (20, 90, 50, 300))).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size * 7 >= 180 THEN p_size * 7 - 360 ELSE p_size * 7 END AS DOUBLE) AS longitude, -40.0::DOUBLE AS west, 20.0::DOUBLE AS east FROM part")
def longitude_continuity(spark, sf_dir):
    region, positive = longitude_region((-40, 20, -10, 10))
    lon = wrap_longitude((F.col("p_size") * 7).cast("double"), positive)
    return _table(spark, sf_dir, "part").select("p_partkey", lon.alias("longitude"), F.lit(region[0]).alias("west"), F.lit(region[1]).alias("east"))


@query("SELECT event_id AS point_id, round(radians(user_id::DOUBLE / 10) * 6371000, 3) AS easting, round(ln(tan(pi() / 4 + radians(value / 10) / 2)) * 6371000, 3) AS northing FROM events")
def project_coordinates_mercator(spark, sf_dir):
    df = _events(spark, sf_dir).df.select("point_id", (F.col("easting") / 10).alias("easting"), (F.col("northing") / 10).alias("northing"))
    return _rounded(project_coordinates(df, mercator), {"easting": 3, "northing": 3})


_SQUARE = lambda e, n: (e * e, n * n)


@query("SELECT round(min(e * e), 6) AS west, round(max(e * e), 6) AS east, round(min(n * n), 6) AS south, round(max(n * n), 6) AS north FROM (SELECT -10 + i * 12 / 100.0::DOUBLE AS e, 2 + j * 8 / 100.0::DOUBLE AS n FROM range(101) a(i), range(101) b(j))")
def project_region_square(spark, sf_dir):
    region = project_region(spark, (-10, 2, 2, 10), _SQUARE)
    return spark.createDataFrame([tuple(round(v, 6) for v in region)], "west double, east double, south double, north double")


# --- blocks ---------------------------------------------------------------------------------------


@query(f"WITH {_labelled(_E, 10, 8)} SELECT point_id, block FROM b")
def block_split_events(spark, sf_dir):
    return block_split(_events(spark, sf_dir).df, shape=(10, 8))[1].select("point_id", "block")


@query(f"WITH {_labelled(_E, 10, 8, '30.0 AS w0, 90.0 AS e0, 100.0 AS s0, 300.0 AS n0')} SELECT block, count(*) AS n FROM b GROUP BY block")
def block_split_outside(spark, sf_dir):
    return block_split(_events(spark, sf_dir).df, shape=(10, 8), region=(30, 90, 100, 300))[1].groupBy("block").agg(F.count("*").alias("n"))


def _reduced(name: str, function: str):
    sql = f"WITH {_labelled(_E, 10, 8)} SELECT block, round({function}(e), 6) AS easting, round({function}(n), 6) AS northing, round({function}(z), 6) AS scalars FROM b GROUP BY block"

    def run(spark, sf_dir):
        return _rounded(block_reduce(_events(spark, sf_dir), name, shape=(10, 8)).df, dict.fromkeys(("easting", "northing", "scalars"), 6))

    run.__name__ = f"block_reduce_{name}"
    query(sql)(run)


for _name, _function in (("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max"), ("sum", "sum"), ("stddev_pop", "stddev_pop"), ("var_samp", "var_samp")):
    _reduced(_name, _function)


@query(f"WITH {_labelled(_L, 7, 9, '0.0 AS w0, 51.3 AS e0, -0.7 AS s0, 10.9 AS n0')} SELECT block, round(avg(e), 6) AS easting, round(avg(n), 6) AS northing, round(sum(w * z) / sum(w), 4) AS scalars FROM b GROUP BY block")
def block_reduce_weighted(spark, sf_dir):
    return _rounded(block_reduce(_items(spark, sf_dir), "mean", shape=(7, 9), region=(0, 51.3, -0.7, 10.9)).df, {"easting": 6, "northing": 6, "scalars": 4})


@query(f"WITH {_labelled(_E, 10, 8)} SELECT block, round(w0 + (block % 8 + 0.5) * ((e0 - w0) / 8), 6) AS easting, round(s0 + (block // 8 + 0.5) * ((n0 - s0) / 10), 6) AS northing, scalars FROM (SELECT block, round(max(z) - min(z), 6) AS scalars FROM b GROUP BY block), box")
def block_reduce_callable(spark, sf_dir):
    return _rounded(block_reduce(_events(spark, sf_dir), np.ptp, shape=(10, 8), center_coordinates=True).df, {"easting": 6, "northing": 6, "scalars": 6})


_TO_WEIGHT = "round(CASE WHEN v > 1e-15 THEN (SELECT min(v) FROM g WHERE v > 1e-15) / v ELSE 1.0 END, 5) AS scalars_weight"


@query(f"WITH {_labelled(_E, 10, 8)}, g AS (SELECT block, avg(e) AS e, avg(n) AS n, avg(z) AS z, coalesce(var_samp(z), 0) AS v FROM b GROUP BY block) SELECT block, round(e, 6) AS easting, round(n, 6) AS northing, round(z, 6) AS scalars, {_TO_WEIGHT} FROM g")
def block_mean_plain(spark, sf_dir):
    return _rounded(block_mean(_events(spark, sf_dir), shape=(10, 8)).df, {"easting": 6, "northing": 6, "scalars": 6, "scalars_weight": 5})


_GL = _labelled(_L, 7, 9, "0.0 AS w0, 51.3 AS e0, -0.7 AS s0, 10.9 AS n0")


@query(f"WITH {_GL}, m AS (SELECT block, avg(e) AS e, avg(n) AS n, sum(w * z) / sum(w) AS z FROM b GROUP BY block), g AS (SELECT block, any_value(m.e) AS e, any_value(m.n) AS n, any_value(m.z) AS z, sum(b.w * (b.z - m.z) * (b.z - m.z)) / sum(b.w) AS v FROM b JOIN m USING (block) GROUP BY block) SELECT block, round(e, 6) AS easting, round(n, 6) AS northing, round(z, 4) AS scalars, {_TO_WEIGHT} FROM g")
def block_mean_weighted(spark, sf_dir):
    return _rounded(block_mean(_items(spark, sf_dir), shape=(7, 9), region=(0, 51.3, -0.7, 10.9)).df, {"easting": 6, "northing": 6, "scalars": 4, "scalars_weight": 5})


@query(f"WITH {_GL}, g AS (SELECT block, avg(e) AS e, avg(n) AS n, sum(w * z) / sum(w) AS z, 1 / sum(w) AS v FROM b GROUP BY block) SELECT block, round(e, 6) AS easting, round(n, 6) AS northing, round(z, 4) AS scalars, {_TO_WEIGHT} FROM g")
def block_mean_uncertainty(spark, sf_dir):
    return _rounded(block_mean(_items(spark, sf_dir), uncertainty=True, shape=(7, 9), region=(0, 51.3, -0.7, 10.9)).df, {"easting": 6, "northing": 6, "scalars": 4, "scalars_weight": 5})


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax > 1e-15 THEN (SELECT min(l_tax) FROM lineitem WHERE l_tax > 1e-15) / l_tax ELSE 1.0 END, 9) AS weight FROM lineitem")
def variance_to_weights_tax(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax")
    return variance_to_weights(df, ["l_tax"], ["weight"]).select("l_orderkey", "l_linenumber", F.round("weight", 9).alias("weight"))


@query("SELECT least(min(l_quantity), min(l_discount)) AS minimum, greatest(max(l_quantity), max(l_discount)) AS maximum FROM lineitem")
def minmax_columns(spark, sf_dir):
    return minmax(_table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])


@query("SELECT round(quantile_cont(x, 0.02), 6) AS minimum, round(quantile_cont(x, 0.98), 6) AS maximum FROM (SELECT value::DOUBLE AS x FROM events UNION ALL SELECT user_id::DOUBLE FROM events)")
def minmax_percentiles(spark, sf_dir):
    return _rounded(minmax(_table(spark, sf_dir, "events"), ["value", "user_id"], min_percentile=2, max_percentile=98), {"minimum": 6, "maximum": 6})


@query("SELECT greatest(max(abs(c_acctbal)), 0) AS maxabs FROM customer")
def maxabs_balance(spark, sf_dir):
    return maxabs(_table(spark, sf_dir, "customer"), ["c_acctbal"])


@query("SELECT round(quantile_cont(abs(c_acctbal)::DOUBLE, 0.9), 6) AS maxabs FROM customer")
def maxabs_percentile(spark, sf_dir):
    return _rounded(maxabs(_table(spark, sf_dir, "customer"), ["c_acctbal"], percentile=90), {"maxabs": 6})


# --- windows --------------------------------------------------------------------------------------

_CENTERS = "c AS (SELECT CAST(r AS INTEGER) AS win_row, CAST(k AS INTEGER) AS win_col, 20.5 + r * (459.0 / 12)::DOUBLE AS cn, 20.5 + k * (109.0 / 9)::DOUBLE AS ce FROM range(13) a(r), range(10) b(k))"


@query(f"WITH p AS ({_E}), {_CENTERS} SELECT win_row, win_col, count(*) AS n, CAST(sum(point_id) AS BIGINT) AS ids FROM c JOIN p ON abs(p.e - ce) <= 20.5 AND abs(p.n - cn) <= 20.5 GROUP BY ALL")
def rolling_window_counts(spark, sf_dir):
    _, members = rolling_window(_events(spark, sf_dir).df, 41.0, shape=(13, 10), region=(0, 150, 0, 500))
    return members.groupBy("win_row", "win_col").agg(F.count("*").alias("n"), F.sum("point_id").alias("ids"))


@query(f"WITH p AS ({_E}), {_CENTERS} SELECT win_row, win_col, CAST(count(point_id) AS INTEGER) AS size, coalesce(min(point_id), -1) AS first FROM c LEFT JOIN p ON abs(p.e - ce) <= 20.5 AND abs(p.n - cn) <= 20.5 GROUP BY ALL")
def rolling_window_lists(spark, sf_dir):
    spec, members = rolling_window(_events(spark, sf_dir).df, 41.0, shape=(13, 10), region=(0, 150, 0, 500))
    return window_lists(spec, members).select("win_row", "win_col", F.size("ids").alias("size"), F.coalesce(F.get("ids", F.lit(0)), F.lit(-1)).alias("first"))


@query(f"WITH p AS ({_E}), s AS (SELECT * FROM (VALUES (0, 20.0), (1, 60.0), (2, 150.0)) t(win, size)) SELECT CAST(win AS INTEGER) AS win, CAST(size AS DOUBLE) AS size, point_id FROM p JOIN s ON abs(e - 75) <= size / 2 AND abs(n - 100) <= size / 2")
def expanding_window_members(spark, sf_dir):
    return expanding_window(_events(spark, sf_dir).df, (75, 100), (20, 60, 150))


# --- neighbours -----------------------------------------------------------------------------------

_TWO = "q AS (SELECT s_suppkey AS qid, s_suppkey * 15.0::DOUBLE AS qe, s_acctbal AS qn FROM supplier), p AS (SELECT c_custkey AS pid, CAST(c_custkey AS DOUBLE) AS pe, c_acctbal AS pn FROM customer)"
_RANKED = f"{_TWO}, r AS (SELECT qid, pid, sqrt((pe - qe) * (pe - qe) + (pn - qn) * (pn - qn)) AS d, row_number() OVER (PARTITION BY qid ORDER BY sqrt((pe - qe) * (pe - qe) + (pn - qn) * (pn - qn)), pid) AS rank FROM q, p)"


def _two_sets(spark, sf_dir):
    q = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), (F.col("s_suppkey") * 15.0).alias("easting"), F.col("s_acctbal").alias("northing"))
    p = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), F.col("c_custkey").cast("double").alias("easting"), F.col("c_acctbal").alias("northing"))
    return q, p


@query(f"WITH {_RANKED} SELECT qid AS query_id, CAST(rank AS INTEGER) AS rank, pid AS point_id, round(d, 6) AS distance FROM r WHERE rank <= 4")
def knn_join_four(spark, sf_dir):
    return _rounded(knn_join(*_two_sets(spark, sf_dir), 4), {"distance": 6})


@query(f"WITH {_RANKED}, g AS (SELECT qid, avg(pn) AS v FROM r JOIN p USING (pid) WHERE rank <= 3 GROUP BY qid) SELECT qid AS query_id, round(v, 4) AS scalars FROM g")
def k_neighbors_mean(spark, sf_dir):
    q, p = _two_sets(spark, sf_dir)
    model = KNeighbors(3).fit(SpatialFrame(p.withColumn("scalars", F.col("northing"))))
    return model.transform(q).select("query_id", F.round("scalars", 4).alias("scalars"))


@query("WITH p AS (SELECT c_custkey AS id, CAST(c_custkey AS DOUBLE) AS e, c_acctbal AS n FROM customer), r AS (SELECT a.id, sqrt((a.e - b.e) * (a.e - b.e) + (a.n - b.n) * (a.n - b.n)) AS d, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.e - b.e) * (a.e - b.e) + (a.n - b.n) * (a.n - b.n)), b.id) AS k FROM p a, p b) SELECT id AS point_id, round(median(d), 6) AS median_distance FROM r WHERE k BETWEEN 2 AND 6 GROUP BY id")
def median_distance_five(spark, sf_dir):
    _, p = _two_sets(spark, sf_dir)
    return _rounded(median_distance(p, 5), {"median_distance": 6})


@query(f"WITH {_TWO} SELECT pid AS point_id, EXISTS (SELECT 1 FROM q WHERE sqrt((pe - qe) * (pe - qe) + (pn - qn) * (pn - qn)) <= 120) AS mask FROM p")
def distance_mask_customers(spark, sf_dir):
    q, p = _two_sets(spark, sf_dir)
    return distance_mask(q, 120.0, coordinates=p).select("point_id", "mask")


@query("WITH p AS (SELECT CAST(user_id AS DOUBLE) AS e, value AS n FROM events), g AS (SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, r * 12.5::DOUBLE AS gn, c * 5.0::DOUBLE AS ge FROM range(61) a(r), range(41) b(c)) SELECT row, col, CASE WHEN EXISTS (SELECT 1 FROM p WHERE sqrt((e - ge) * (e - ge) + (n - gn) * (n - gn)) <= 9) THEN 1.0::DOUBLE END AS scalars FROM g")
def distance_mask_grid(spark, sf_dir):
    spec = GridSpec.make((0, 200, 0, 750), shape=(61, 41))
    grid = make_grid(spec, spec.to_df(spark).select("row", "col", F.lit(1.0).alias("scalars")))
    return distance_mask(_events(spark, sf_dir).df, 9.0, grid=grid).df.select("row", "col", "scalars")


@query("SELECT event_id AS point_id, user_id - value / 3 <= 60 AND user_id + value / 3 >= 60 AND user_id + value / 3 <= 140 AND user_id - value / 3 >= -20 AS mask FROM events")
def convexhull_mask_events(spark, sf_dir):
    corners = spark.createDataFrame([(100.0, 120.0), (60.0, 0.0), (20.0, 120.0), (60.0, 240.0), (60.0, 100.0)], "easting double, northing double")
    return convexhull_mask(corners, coordinates=_events(spark, sf_dir).df).select("point_id", "mask")


# --- models ---------------------------------------------------------------------------------------

_LINE = f"WITH p AS ({_L}), m AS (SELECT sum(w) AS sw, sum(w * e) / sum(w) AS em, sum(w * n) / sum(w) AS nm, sum(w * z) / sum(w) AS zm FROM p), c AS (SELECT any_value(em) AS em, any_value(nm) AS nm, any_value(zm) AS zm, sum(w * (e - em) * (e - em)) AS ee, sum(w * (e - em) * (n - nm)) AS en, sum(w * (n - nm) * (n - nm)) AS nn, sum(w * (e - em) * (z - zm)) AS ez, sum(w * (n - nm) * (z - zm)) AS nz FROM p, m), k AS (SELECT *, (ez * nn - nz * en) / (ee * nn - en * en) AS a, (nz * ee - ez * en) / (ee * nn - en * en) AS b FROM c), f AS (SELECT zm - a * em - b * nm AS c0, a, b FROM k)"


@query(f"{_LINE} SELECT CAST(0 AS INTEGER) AS term, round(c0, 4) AS coef FROM f UNION ALL SELECT 1, round(a, 4) FROM f UNION ALL SELECT 2, round(b, 4) FROM f")
def trend_fit(spark, sf_dir):
    model = Trend(1).fit(_items(spark, sf_dir))
    return spark.createDataFrame([(k, round(float(c), 4)) for k, c in enumerate(model.coef_)], "term int, coef double")


@query(f"{_LINE} SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, round(c0 + a * c * 5.0 + b * r * 1.0, 3) AS scalars FROM f, range(11) x(r), range(11) y(c)")
def trend_grid(spark, sf_dir):
    grid = Trend(1).fit(_items(spark, sf_dir)).grid(spark, region=(0, 50, 0, 10), shape=(11, 11))
    return grid.df.select("row", "col", F.round("scalars", 3).alias("scalars"))


@query(f"{_LINE} SELECT CAST(i AS INTEGER) AS idx, round(i * 5.0::DOUBLE, 6) AS easting, round(i * 1.0::DOUBLE, 6) AS northing, round(c0 + a * i * 5.0 + b * i * 1.0, 3) AS scalars FROM f, range(11) x(i)")
def trend_profile(spark, sf_dir):
    line = Trend(1).fit(_items(spark, sf_dir)).profile(spark, (0, 0), (50, 10), 11)
    return line.select("idx", F.round("easting", 6).alias("easting"), F.round("northing", 6).alias("northing"), F.round("scalars", 3).alias("scalars"))


@query(f"{_LINE} SELECT round(1 - sum(w * (z - c0 - a * e - b * n) ** 2) / sum(w * (z - zm) ** 2), 8) AS r2, round(-sqrt(sum(w * (z - c0 - a * e - b * n) ** 2) / sum(w)), 4) AS rmse, round(-sum(w * abs(z - c0 - a * e - b * n)) / sum(w), 4) AS mae FROM p, f, m")
def trend_score(spark, sf_dir):
    frame = _items(spark, sf_dir)
    model = Trend(1).fit(frame)
    row = (round(model.score(frame, "r2"), 8), round(model.score(frame, "neg_root_mean_squared_error"), 4), round(model.score(frame, "neg_mean_absolute_error"), 4))
    return spark.createDataFrame([row], "r2 double, rmse double, mae double")


@query(f"{_LINE} SELECT count(*) AS n, round(abs(sum(w * (z - c0 - a * e - b * n))) / sum(w), 4) AS mean, round(sqrt(sum(w * (z - c0 - a * e - b * n) ** 2) / sum(w)), 4) AS spread FROM p, f")
def trend_filter(spark, sf_dir):
    left = Trend(1).filter(_items(spark, sf_dir)).df
    r, w = F.col("scalars"), F.col("weight")
    return left.agg(F.count("*").alias("n"), F.round(F.abs(F.sum(w * r)) / F.sum(w), 4).alias("mean"), F.round(F.sqrt(F.sum(w * r * r) / F.sum(w)), 4).alias("spread"))


@query("SELECT event_id AS point_id, round(3 + 0.5 * user_id - 0.02 * value + 0.001 * user_id * user_id + 0.0005 * user_id * value - 0.00001 * value * value, 3) AS scalars FROM events")
def trend_recovers_quadratic(spark, sf_dir):
    frame = _events(spark, sf_dir)
    e, n = F.col("easting"), F.col("northing")
    frame = frame.on(frame.df.withColumn("scalars", 3 + 0.5 * e - 0.02 * n + 0.001 * e * e + 0.0005 * e * n - 0.00001 * n * n))
    return Trend(2).fit(frame).transform(frame.df.drop("scalars")).select("point_id", F.round("scalars", 3).alias("scalars"))


@query(f"WITH p AS ({_E}) SELECT point_id, round((SELECT avg(z) FROM p), 4) AS east_component, round((SELECT avg(n) FROM p), 4) AS north_component FROM p")
def vector_of_trends(spark, sf_dir):
    frame = _events(spark, sf_dir)
    df = frame.df.withColumn("up", F.col("northing"))
    out = Vector([Trend(0), Trend(0)]).fit(SpatialFrame(df, data=("scalars", "up"))).transform(df.select("point_id", "easting", "northing"))
    return _rounded(out.select("point_id", "east_component", "north_component"), {"east_component": 4, "north_component": 4})


@query(f"WITH {_labelled(_E, 10, 8)}, g AS (SELECT block, avg(z) AS z FROM b GROUP BY block) SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, round((SELECT avg(z) FROM g), 4) AS scalars FROM range(4) x(r), range(5) y(c)")
def chain_block_trend(spark, sf_dir):
    chain = Chain([("blocks", BlockReduce("mean", shape=(10, 8))), ("trend", Trend(0))]).fit(_events(spark, sf_dir))
    return chain.grid(spark, shape=(4, 5)).df.select("row", "col", F.round("scalars", 4).alias("scalars"))


_FORCES = [(10.0, 40.0, 1.5), (80.0, 300.0, -2.0), (140.0, 120.0, 0.75), (60.0, 410.0, 1.0)]
_GREEN = lambda de, dn, m: f"(CASE WHEN {_R(de, dn, m)} < 1 THEN {_R(de, dn, m)} * (ln(pow({_R(de, dn, m)}, {_R(de, dn, m)})) - {_R(de, dn, m)}) ELSE pow({_R(de, dn, m)}, 2) * (ln({_R(de, dn, m)}) - 1) END)"
_R = lambda de, dn, m: f"(sqrt(pow({de}, 2) + pow({dn}, 2)) + {m})"


@query(f"SELECT event_id AS point_id, round(sum(f * {_GREEN('(user_id - x)', '(value - y)', 0)}) / 1000, 4) AS scalars FROM events, {_values(_FORCES, 'x, y, f')} GROUP BY event_id")
def spline_predict(spark, sf_dir):
    f = np.array(_FORCES)
    model = FittedSpline(mindist=0.0, force_=f[:, 2], force_coords_=f[:, :2])
    return model.transform(_events(spark, sf_dir).df.drop("scalars")).select("point_id", F.round(F.col("scalars") / 1000, 4).alias("scalars"))


@query(SQL["spline_predict"])
def spline_predict_join(spark, sf_dir):
    f = np.array(_FORCES)
    forces = FittedSpline(mindist=0.0, force_=f[:, 2], force_coords_=f[:, :2]).forces(spark)
    out = predict_by_join(_events(spark, sf_dir).df, F.broadcast(forces), 0.0)  # four forces
    return out.select("point_id", F.round(F.col("scalars") / 1000, 4).alias("scalars"))


_KE, _KN = "(user_id - x)", "(value - y)"
_KR = "(sqrt(pow(user_id - x, 2) + pow(value - y, 2)) + 100)"


@query(f"SELECT event_id AS point_id, round(sum((2.5 * ln({_KR}) + 1.5 * pow({_KN} / {_KR}, 2)) * f - 1.5 * {_KE} * {_KN} / pow({_KR}, 2) * g), 6) AS east_component, round(sum(-1.5 * {_KE} * {_KN} / pow({_KR}, 2) * f + (2.5 * ln({_KR}) + 1.5 * pow({_KE} / {_KR}, 2)) * g), 6) AS north_component FROM events, {_values([(a, b, c, -c / 2) for a, b, c in _FORCES], 'x, y, f, g')} GROUP BY event_id")
def vector_spline_predict(spark, sf_dir):
    f = np.array(_FORCES)
    model = FittedVectorSpline2D(poisson=0.5, mindist=100.0, force_=np.concatenate([f[:, 2], -f[:, 2] / 2]), force_coords_=f[:, :2], n_data=2)
    out = model.transform(_events(spark, sf_dir).df.drop("scalars")).select("point_id", "east_component", "north_component")
    return _rounded(out, {"east_component": 6, "north_component": 6})


@query("SELECT vec_id AS point_id, round(embedding[3]::DOUBLE, 4) AS scalars FROM embeddings")
def spline_fit(spark, sf_dir):
    frame = _scatter(spark, sf_dir)
    return Spline().fit(frame).transform(frame.df.drop("scalars")).select("point_id", F.round("scalars", 4).alias("scalars"))


@query()
def spline_damped(spark, sf_dir):
    frame = _scatter(spark, sf_dir)
    side = np.linspace(-0.3, 0.3, 6)
    model = Spline(mindist=0.01, damping=1e-3, force_coords=np.array([(x, y) for x in side for y in side])).fit(frame)
    return model.transform(frame.df.drop("scalars")).select("point_id", "scalars")


@query()
def spline_cv(spark, sf_dir):
    board = CheckerBoard(region=(0, 5000, -5000, 0)).scatter(spark, size=150, random_state=1)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        model = SplineCV(dampings=(None, 1e-3), cv=KFold(2, shuffle=True, random_state=0)).fit(SpatialFrame(board))
    return spark.createDataFrame([(model.damping_ is None, float(max(model.scores_)))], "exact boolean, score double")


@query()
def vector_spline_fit(spark, sf_dir):
    df = CheckerBoard(region=(0, 5000, -5000, 0)).scatter(spark, size=120, random_state=2).withColumn("north", F.col("scalars") / 2)
    frame = SpatialFrame(df, data=("scalars", "north"))
    return VectorSpline2D(mindist=500.0).fit(frame).grid(spark, shape=(10, 10)).df


@query(f"SELECT event_id AS point_id, round(1000 * sin(2 * pi() / 75 * user_id) * cos(2 * pi() / 250 * value), 6) AS scalars FROM events")
def checkerboard_model(spark, sf_dir):
    board = CheckerBoard(region=(0, 150, 0, 500))
    return board.transform(_events(spark, sf_dir).df.drop("scalars")).select("point_id", F.round("scalars", 6).alias("scalars"))


@query(f"SELECT CAST(k AS BIGINT) AS point_id, round(1000 * sin(2 * pi() / 75 * x) * cos(2 * pi() / 250 * y), 6) AS scalars FROM {_values(_draws(), 'k, x, y')}")
def checkerboard_scatter(spark, sf_dir):
    return CheckerBoard(region=(0, 150, 0, 500)).scatter(spark, size=50, random_state=4).select("point_id", F.round("scalars", 6).alias("scalars"))


@query("SELECT vec_id AS point_id, round(2 * embedding[1]::DOUBLE - 3 * embedding[2]::DOUBLE + 1, 6) AS scalars FROM embeddings")
def linear_interpolation(spark, sf_dir):
    frame = _scatter(spark, sf_dir)
    plane = frame.on(frame.df.withColumn("scalars", 2 * F.col("easting") - 3 * F.col("northing") + 1))
    return Linear().fit(plane).transform(frame.df.drop("scalars")).select("point_id", F.round("scalars", 6).alias("scalars"))


@query("SELECT vec_id AS point_id, round(2 * embedding[1]::DOUBLE - 3 * embedding[2]::DOUBLE + 1, 5) AS scalars FROM embeddings")
def cubic_interpolation(spark, sf_dir):
    frame = _scatter(spark, sf_dir)
    plane = frame.on(frame.df.withColumn("scalars", 2 * F.col("easting") - 3 * F.col("northing") + 1))
    return Cubic().fit(plane).transform(frame.df.drop("scalars")).select("point_id", F.round("scalars", 5).alias("scalars"))


@query()
def project_grid_nearest(spark, sf_dir):
    spec = GridSpec.make((2, 10, 2, 10), shape=(9, 9))
    grid = make_grid(spec, spec.to_df(spark).select("row", "col", F.lit(1.0).alias("ones")))
    return project_grid(grid, _SQUARE, method="nearest", antialias=False).df


# --- selection ------------------------------------------------------------------------------------

_FOLDS = f"WITH {_labelled(_E, 10, 8)}, s AS (SELECT block, count(*) AS n FROM b GROUP BY block), r AS (SELECT block, sum(n) OVER (ORDER BY block) AS c, (SELECT sum(n) FROM s) // 5 AS ideal FROM s), f AS (SELECT block, CAST(least(c // ideal, 4) AS INTEGER) AS fold FROM r)"


def _prefix_fold() -> str:
    # a cut stands after the last block whose running sum is at most k * ideal
    return f"{_FOLDS}, g AS (SELECT r.block, CAST((SELECT count(*) FROM range(1, 5) t(k) WHERE r.c > k * r.ideal) AS INTEGER) AS fold FROM r)"


@query(f"{_prefix_fold()} SELECT point_id, fold FROM b JOIN g USING (block)")
def block_kfold(spark, sf_dir):
    df = _events(spark, sf_dir).df
    labelled, table = BlockKFold(shape=(10, 8), n_splits=5).split_table(df)
    return labelled.join(F.broadcast(table), "block").select("point_id", F.col("split").alias("fold"))  # the lattice's 80 blocks


@query()
def block_shuffle_split(spark, sf_dir):
    _, table = BlockShuffleSplit(shape=(10, 8), n_splits=3, random_state=0).split_table(_events(spark, sf_dir).df)
    return table


@query("SELECT CAST(2 AS INTEGER) AS parts, CAST(0 AS INTEGER) AS k, CAST(2 AS INTEGER) AS cut UNION ALL SELECT 3, 0, 1 UNION ALL SELECT 3, 1, 2")
def partition_by_sum_cases(spark, sf_dir):
    rows = [(p, k, int(c)) for p in (2, 3) for k, c in enumerate(partition_by_sum([4, 4, 4, 4], p))]
    return spark.createDataFrame(rows, "parts int, k int, cut int")


_DEAL = "CAST('0x' || substr(md5('{}-' || vec_id), 1, 7) AS BIGINT)"


@query(f"SELECT vec_id AS point_id, {_DEAL.format(7)} / 268435456.0 < 0.2 AS test FROM embeddings")
def train_test_split_points(spark, sf_dir):
    train, test = train_test_split(_scatter(spark, sf_dir), test_size=0.2, random_state=7, id_col="point_id", hashed=True)
    return train.df.select("point_id", F.lit(False).alias("test")).unionByName(test.df.select("point_id", F.lit(True).alias("test")))


@query(f"WITH j AS (SELECT CAST({_DEAL.format(3)} % 5 AS INTEGER) AS fold, embedding[3]::DOUBLE AS z FROM embeddings), m AS (SELECT a.fold, (SELECT avg(z) FROM j b WHERE b.fold <> a.fold) AS c FROM (SELECT DISTINCT fold FROM j) a) SELECT fold, round(-sqrt(avg((z - c) ** 2)), 6) AS score FROM j JOIN m USING (fold) GROUP BY fold")
def cross_val_score_trend(spark, sf_dir):
    scores = cross_val_score(Trend(0), _scatter(spark, sf_dir), cv=KFold(5, random_state=3, id_col="point_id", hashed=True), scoring="neg_root_mean_squared_error")
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(scores)], "fold int, score double")


# --- sources and streams --------------------------------------------------------------------------

_SURFER = "DSAA\n2 6\n1 1000\n2 2000\n11 61\n11 21 31 41 51 61\n61 51 41 31 21 1.70141e38\n"


_SURFER_SQL = "SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, CASE WHEN r = 0 THEN 1.0 ELSE 1000.0 END::DOUBLE AS northing, round(2 + c * 1998 / 5.0::DOUBLE, 6) AS easting, CASE WHEN r = 0 THEN 11.0 + 10 * c WHEN c < 5 THEN 61.0 - 10 * c END::DOUBLE AS scalars FROM range(2) a(r), range(6) b(c)"


@query(_SURFER_SQL)
def surfer_grid(spark, sf_dir):
    return _rounded(load_surfer(spark, io.StringIO(_SURFER)).df, {"easting": 6})


@query(_SURFER_SQL)
def surfer_source(spark, sf_dir):
    from gridspark.scratch import folder

    path = f"{folder(spark)}/surfer-sample"
    spark.createDataFrame([(_SURFER.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    spark.dataSource.register(SurferSource)
    name = [f for f in spark.read.format("binaryFile").load(path).select("path").toPandas()["path"] if "part-" in f][0]
    return _rounded(spark.read.format("surfer").load(name).drop("file"), {"easting": 6})


@query("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, block, count(*) AS n, round(avg(z), 6) AS scalars FROM (WITH p AS (SELECT ts, CAST(user_id AS DOUBLE) AS e, value AS n, CAST(event_id AS DOUBLE) AS z FROM events) SELECT ts, z, CAST(least(greatest(floor(n / 125.0::DOUBLE), 0), 3) * 3 + least(greatest(floor(e / 50.0::DOUBLE), 0), 2) AS BIGINT) AS block FROM p) GROUP BY ALL")
def streaming_blocks_batch(spark, sf_dir):
    df = _table(spark, sf_dir, "events").select("ts", F.col("user_id").cast("double").alias("easting"), F.col("value").alias("northing"), F.col("event_id").cast("double").alias("scalars"))
    return _rounded(block_counts(df, (0, 150, 0, 500), shape=(4, 3)), {"scalars": 6}).withColumn("start", F.unix_timestamp("start"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block mean with weights, trend, and its grid over the events."""
    frame = _events(spark, sf_dir)
    chain = Chain([("mean", BlockMean(shape=(10, 10))), ("trend", Trend(1))]).fit(frame)
    return chain.grid(spark, shape=(20, 20)).df
