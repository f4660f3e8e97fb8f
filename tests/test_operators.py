import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark import block_mean, block_reduce, block_split, convexhull_mask, distance_mask, expanding_window, knn_join, maxabs, median_distance, minmax, rolling_window, variance_to_weights, window_lists
from gridspark.operators.geometry import convex_hull, delaunay
from gridspark.spec import GridSpec, SpatialFrame, make_grid


def _frame(spark, rows, columns="easting double, northing double, scalars double", **roles):
    return SpatialFrame(spark.createDataFrame(rows, columns), **roles)


def test_block_labels_of_a_small_lattice(spark):
    lattice = GridSpec.make((-5, 0, 5, 10), spacing=1).to_df(spark)
    spec, out = block_split(lattice, spacing=2.5)
    labels = {(r.row, r.col): r.block for r in out.collect()}
    assert spec.easting.tolist() == [-3.75, -1.25] and spec.northing.tolist() == [6.25, 8.75]
    assert [[labels[i, j] for j in range(6)] for i in range(6)] == [[0, 0, 0, 1, 1, 1]] * 3 + [[2, 2, 2, 3, 3, 3]] * 3
    # points beyond the region belong to the border blocks; one block has label 0
    far = spark.createDataFrame([(-100.0, 100.0), (100.0, -100.0)], "easting double, northing double")
    assert sorted(r.block for r in block_split(far, spacing=2.5, region=(-5, 0, 5, 10))[1].collect()) == [1, 2]
    assert {r.block for r in block_split(spark.createDataFrame([(1.0, 1.0)] * 3, "easting double, northing double"), shape=(2, 2))[1].collect()} == {0}


@pytest.mark.parametrize("partitions", [1, 4, 32])
def test_block_reduce_does_not_depend_on_partitions(spark, partitions):
    rows = [(float(k % 10), float(k % 7), float(k)) for k in range(200)]
    frame = _frame(spark, rows)
    out = block_reduce(frame.on(frame.df.repartition(partitions)), "median", shape=(3, 3))
    assert {r.block: r.scalars for r in out.df.collect()} == {r.block: r.scalars for r in block_reduce(frame, np.median, shape=(3, 3)).df.collect()}


def test_block_reduce_details(spark):
    rows = [(0.1, 0.1, 1.0, 1.0, 9.0), (0.2, 0.2, float("nan"), 1.0, 9.0), (0.3, 0.1, 5.0, 0.0, 9.0), (1.9, 1.9, 7.0, 0.0, 9.0)]
    frame = _frame(spark, rows, "easting double, northing double, scalars double, w double, height double", coords=("easting", "northing", "height"), weights=("w",))
    out = block_reduce(frame, "mean", shape=(2, 2), region=(0, 2, 0, 2), center_coordinates=True, drop_coords=False)
    got = {r.block: (r.easting, r.northing, r.height, r.scalars) for r in out.df.collect()}
    assert got == {0: (0.5, 0.5, 9.0, 1.0), 3: (1.5, 1.5, 9.0, None)} and out.weights is None
    with pytest.raises(ValueError):
        block_reduce(frame, "nonsense", shape=(2, 2))
    with pytest.raises(ValueError):
        SpatialFrame(frame.df, data=("nothing",))
    with pytest.raises(ValueError):
        SpatialFrame(frame.df, weights=("w", "w"))


def test_block_mean_weights(spark):
    rows = [(float(b), 0.0, z) for b, z in ((0, 1.0), (0, 2.0), (1, 10.0), (1, 20.0), (2, 5.0), (2, 5.0), (3, 8.0))]
    out = {r.block: (r.scalars, r.scalars_weight) for r in block_mean(_frame(spark, rows), shape=(1, 4), region=(-0.5, 3.5, 0, 1)).df.collect()}
    assert out == {0: (1.5, 1.0), 1: (15.0, 0.01), 2: (5.0, 1.0), 3: (8.0, 1.0)}
    with pytest.raises(ValueError):
        block_mean(_frame(spark, rows), uncertainty=True, shape=(1, 4))
    weighted = _frame(spark, [(0.0, 0.0, 100.0 + k % 2, 1.0 / (1 + k % 2)) for k in range(10)], "easting double, northing double, scalars double, w double", weights=("w",))
    row = block_mean(weighted, shape=(1, 1), region=(0, 1, 0, 1)).df.first()
    assert row.scalars == pytest.approx(100 + 1 / 3) and row.scalars_weight == 1


def test_variance_to_weights(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (0.2,), (1e-16,), (None,), (float("nan"),)], "v double")
    assert [r.w for r in variance_to_weights(df, ["v"], ["w"]).select("w").collect()] == pytest.approx([1, 0.1, 1, 1, 1, 1])


def test_ranges(spark):
    df = spark.createDataFrame([(1.0, -10.0), (25.0, 2.0), (float("nan"), 3.0)], "a double, b double")
    assert tuple(minmax(df, ["a", "b"]).first()) == (-10, 25) and maxabs(df, ["a", "b"]).first()[0] == 25
    assert np.isnan(maxabs(df, ["a"], nan=False).first()[0])
    x = [1.0, 25.0, -10.0, 2.0, 3.0]
    assert minmax(df, ["a", "b"], min_percentile=10, max_percentile=90).first()[1] == pytest.approx(np.percentile(x, 90))
    for bad in (lambda: minmax(df, ["a"], min_percentile=-1), lambda: maxabs(df, ["a"], percentile=101)):
        with pytest.raises(ValueError):
            bad()


def test_windows(spark):
    points = GridSpec.make((-5, -1, 6, 10), spacing=1).to_df(spark).withColumn("point_id", F.col("row") * 5 + F.col("col"))
    spec, members = rolling_window(points, 2.0, spacing=2)
    lists = {(r.win_row, r.win_col): r.ids for r in window_lists(spec, members).collect()}
    assert lists == {(0, 0): [0, 1, 2, 5, 6, 7, 10, 11, 12], (0, 1): [2, 3, 4, 7, 8, 9, 12, 13, 14], (1, 0): [10, 11, 12, 15, 16, 17, 20, 21, 22], (1, 1): [12, 13, 14, 17, 18, 19, 22, 23, 24]}
    with pytest.raises(ValueError):
        rolling_window(points, 9.0, spacing=2)
    with pytest.warns(UserWarning):
        rolling_window(points, 1.0, spacing=2)
    wins = expanding_window(points, (-3, 8), (1, 2, 4)).groupBy("win").count().orderBy("win").collect()
    assert [r["count"] for r in wins] == [1, 9, 25]


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    p = np.round(np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(50, 1, (50, 2)), [[0, 0]] * 3]), 2)
    q = np.round(np.concatenate([rng.uniform(-3, 55, (40, 2)), [[1e4, -1e4]]]), 2)
    df = lambda a, name: spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(a)], f"{name} long, easting double, northing double")
    for k in (1, 5):
        got = {(r.query_id, r["rank"]): (r.point_id, r.distance) for r in knn_join(df(q, "query_id"), df(p, "point_id"), k).collect()}
        d = np.hypot(q[:, None, 0] - p[None, :, 0], q[:, None, 1] - p[None, :, 1])
        for i in range(len(q)):
            for r, j in enumerate(np.lexsort((np.arange(len(p)), d[i]))[:k], 1):
                assert got[i, r] == (j, pytest.approx(d[i, j]))
    assert knn_join(df(q, "query_id"), df(p[:2], "point_id"), 5).count() == 2 * len(q)
    assert knn_join(df(q, "query_id"), df(p, "point_id").limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        knn_join(df(q, "query_id"), df(p, "point_id"), 0)
    lattice = GridSpec.make((5, 10, -20, -17), spacing=1).to_df(spark).withColumn("point_id", F.col("row") * 6 + F.col("col"))
    assert {r.median_distance for r in median_distance(lattice, 1).collect()} == {1.0}


def test_candidates_of_neighbours_are_ranked_by_more_tasks_where_there_are_more(spark, monkeypatch):
    from gridspark.operators import neighbors

    monkeypatch.setattr(neighbors, "PER_TASK", 1000, raising=False)
    ranked, settle = [], neighbors.settle

    def spy(df):
        if "rank" in df.columns:
            ranked.append(df.rdd.getNumPartitions())
        return settle(df)

    monkeypatch.setattr(neighbors, "settle", spy)
    p = np.random.default_rng(8).uniform(0, 1000, (2000, 2))
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], "point_id long, easting double, northing double")
    got = {r.point_id: r.median_distance for r in median_distance(df, 5).collect()}
    assert max(ranked) >= 50
    d = np.sort(np.hypot(p[:, None, 0] - p[None, :, 0], p[:, None, 1] - p[None, :, 1]), 1)[:, 1:6]
    assert [got[k] for k in range(2000)] == pytest.approx(list(np.median(d, 1)))


def test_masks(spark):
    spec = GridSpec.make((0, 5, -10, -4), spacing=1)
    grid = make_grid(spec, spec.to_df(spark).select("row", "col", F.lit(1.0).alias("scalars")))
    near = distance_mask(spark.createDataFrame([(2.5, -7.5)], "easting double, northing double"), 2, grid=grid).to_arrays()["scalars"]
    expected = np.zeros((7, 6), bool)
    expected[1:5, 1:5] = True
    expected[[1, 1, 4, 4], [1, 4, 1, 4]] = False
    expected = np.hypot(spec.easting[None] - 2.5, spec.northing[:, None] + 7.5) <= 2
    assert (~np.isnan(near) == expected).all()
    corners = spark.createDataFrame([(2.0, -9.0), (3.0, -9.0), (2.0, -6.0), (3.0, -6.0)], "easting double, northing double")
    inside = ~np.isnan(convexhull_mask(corners, grid=grid).to_arrays()["scalars"])
    expected = np.zeros((7, 6), bool)
    expected[1:5, 2:4] = True
    assert (inside == expected).all()
    with pytest.raises(ValueError):
        convexhull_mask(corners)
    with pytest.raises(ValueError):
        distance_mask(corners, 1)
    with pytest.raises(ValueError):
        distance_mask(corners, 0, grid=grid)
    assert len(convex_hull(corners.limit(0))) == 0


@pytest.mark.parametrize("points", [np.random.default_rng(0).normal(size=(200, 2)), np.array([(x, y) for x in range(6) for y in range(5)], float)])
def test_delaunay_covers_the_hull_with_empty_circles(points):
    triangles, near = delaunay(points)
    a, b, c = (points[triangles[:, k]] for k in range(3))
    area = ((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]) / 2
    assert (area > 0).all()
    from gridspark.operators.geometry import _in_circle, monotone_chain

    h = np.array(monotone_chain(points))
    assert area.sum() == pytest.approx(abs((h[:, 0] * np.roll(h[:, 1], -1) - h[:, 1] * np.roll(h[:, 0], -1)).sum()) / 2)
    assert not any(_in_circle(*map(tuple, points[t]), tuple(p)) for t in triangles for p in points)
    for t, row in enumerate(near):
        for k, other in enumerate(row):
            if other >= 0:
                assert len(set(triangles[t]) & set(triangles[other])) == 2 and triangles[t][k] not in triangles[other]


def test_delaunay_refuses_degenerate_points():
    for bad in ([(0, 0), (1, 1)], [(0, 0), (1, 1), (2, 2)], [(0, 0)] * 5):
        with pytest.raises(ValueError):
            delaunay(np.array(bad, float))


@pytest.mark.parametrize("name", ["scatter", "lattice", "clusters"])
def test_delaunay_by_tiles_is_the_whole_one(spark, monkeypatch, name):
    from gridspark.operators import geometry

    monkeypatch.setattr(geometry, "MAX_TRIANGULATED", 300)
    monkeypatch.setattr(geometry, "PER_TILE", 250)
    rng = np.random.default_rng(1)
    points = {"scatter": rng.normal(size=(1500, 2)), "lattice": np.array([(x, y) for x in range(40) for y in range(30)], float), "clusters": np.concatenate([rng.normal(c, 0.01, (400, 2)) for c in ((0, 0), (5, 5), (0, 9))])}[name]
    points = np.unique(points, axis=0)
    triangles, near = geometry.delaunay_by_tiles(spark, points)
    whole, _ = delaunay(points, unique=True)
    assert sorted(map(sorted, triangles.tolist())) == sorted(map(sorted, whole.tolist()))
    for t, row in enumerate(near.tolist()):
        assert all(g < 0 or (len({*triangles[t]} & {*triangles[g]}) == 2 and triangles[t][k] not in triangles[g]) for k, g in enumerate(row))
