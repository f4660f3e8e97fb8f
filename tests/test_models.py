import io
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark import BlockKFold, BlockMean, BlockReduce, Chain, CheckerBoard, Cubic, KFold, KNeighbors, Linear, ScipyGridder, Spline, SplineCV, Trend, Vector, VectorSpline2D, cross_val_score, load_surfer, project_grid, train_test_split
from gridspark.plans.solve import least_squares, terms
from gridspark.sources.surfer import SurferSource
from gridspark.spec import GridSpec, SpatialFrame, make_grid


def _lattice(spark, region, shape, value):
    df = GridSpec.make(region, shape=shape).to_df(spark)
    return df.withColumn("scalars", value(F.col("easting"), F.col("northing")))


def test_trend_recovers_coefficients(spark):
    df = _lattice(spark, (1000, 5000, -5000, -1000), (50, 50), lambda e, n: 10 + 2 * e - 0.4 * n)
    model = Trend(1).fit(SpatialFrame(df))
    assert model.coef_ == pytest.approx([10, 2, -0.4], rel=1e-6)
    assert model.score(SpatialFrame(df), "r2") == pytest.approx(1)
    spoiled = df.withColumn("scalars", F.when((F.col("row") == 20) & (F.col("col") == 20), 1e5).otherwise(F.col("scalars"))).withColumn("w", F.when((F.col("row") == 20) & (F.col("col") == 20), 1e-10).otherwise(1.0))
    assert Trend(1).fit(SpatialFrame(spoiled, weights=("w",))).coef_ == pytest.approx([10, 2, -0.4], rel=1e-5)
    with pytest.raises(ValueError):
        Trend(-1)
    assert terms(2) == [(0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2)]


def test_trend_on_too_few_points_is_minimum_norm(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 4.0, 5.0)], "easting double, northing double, scalars double")
    with pytest.warns(UserWarning):
        model = Trend(1).fit(SpatialFrame(df))
    out = model.transform(df.drop("scalars")).orderBy("easting").collect()
    assert [r.scalars for r in out] == pytest.approx([3, 5])


def test_least_squares_damping_shrinks():
    rng = np.random.default_rng(0)
    a, x = rng.normal(size=(40, 3)), np.array([1.0, -2.0, 0.5])
    assert least_squares(a, a @ x) == pytest.approx(x)
    assert np.abs(least_squares(a, a @ x, damping=1e4)).max() < 0.1


def test_vector_and_chain(spark):
    df = _lattice(spark, (0, 10, 0, 10), (11, 11), lambda e, n: 1 + e).withColumn("up", 2 - F.col("northing"))
    frame = SpatialFrame(df, data=("scalars", "up"))
    model = Vector([Trend(1), Trend(1)]).fit(frame)
    assert model.score(frame, "r2") == pytest.approx(1)
    grid = model.grid(spark, shape=(3, 3)).to_arrays()
    assert grid["east_component"][0].tolist() == pytest.approx([1, 6, 11]) and grid["north_component"][:, 0].tolist() == pytest.approx([2, -3, -8])
    chain = Chain([("mean", BlockMean(shape=(4, 4))), ("inner", Chain([("t0", Trend(0)), ("t1", Trend(1))]))])
    assert chain.fit(SpatialFrame(df)).score(SpatialFrame(df), "r2") == pytest.approx(1)
    assert list(chain.named_steps) == ["mean", "inner"]
    with pytest.raises(ValueError):
        Chain([("mean", BlockReduce("mean", shape=(2, 2)))]).fit(SpatialFrame(df))
    with pytest.raises(ValueError):
        Vector([Trend(1)]).fit(frame)


def test_spline_recovers_checkerboard(spark):
    board = CheckerBoard(region=(100, 500, -800, -700))
    data = board.scatter(spark, size=800, random_state=0)
    model = Spline().fit(SpatialFrame(data))
    both = model.transform(data.withColumnRenamed("scalars", "true")).select("true", "scalars").toPandas()
    assert np.allclose(both["true"], both["scalars"], rtol=1e-4, atol=1e-2)
    region = (150, 450, -780, -720)
    spline, truth = (m.grid(spark, region=region, shape=(8, 9)).to_arrays()["scalars"] for m in (model, board))
    assert np.abs(spline - truth).max() < 60
    with pytest.warns(UserWarning):
        Spline().fit(SpatialFrame(data.limit(20).withColumn("w", F.lit(1.0)), weights=("w",)))


def test_damped_spline_same_on_executors_and_driver(spark):
    data = CheckerBoard().scatter(spark, size=60, random_state=1)
    rows = data.select("easting", "northing").toPandas().to_numpy()
    own = Spline(damping=1e-3).fit(SpatialFrame(data))
    given = Spline(damping=1e-3, force_coords=rows).fit(SpatialFrame(data))
    a, b = (m.transform(data.drop("scalars")).orderBy("point_id").toPandas().scalars for m in (own, given))
    assert np.allclose(a, b, rtol=1e-5, atol=1e-3)


def test_spline_cv_and_vector_spline(spark):
    data = CheckerBoard().scatter(spark, size=80, random_state=0)
    model = SplineCV(dampings=(1e-8, 1e6), cv=KFold(2, True, 0), scoring="r2").fit(SpatialFrame(data))
    assert model.damping_ == 1e-8 and len(model.scores_) == 2
    frame = SpatialFrame(data.withColumn("same", F.col("scalars")), data=("scalars", "same"))
    assert VectorSpline2D(mindist=100).fit(frame).score(frame, "r2") == pytest.approx(1, abs=1e-3)
    with pytest.raises(ValueError):
        VectorSpline2D().fit(SpatialFrame(data))


@pytest.mark.parametrize("gridder,tolerance", [(Linear(), 90), (Cubic(), 25), (Linear(rescale=True), 90), (KNeighbors(), 250)])
def test_interpolators(spark, gridder, tolerance):
    board = CheckerBoard(region=(1000, 5000, -8000, -6000))
    model = gridder.fit(SpatialFrame(board.scatter(spark, size=3000, random_state=0)))
    region = (1500, 4500, -7500, -6500)
    a, b = (m.grid(spark, region=region, shape=(9, 10)).to_arrays()["scalars"] for m in (model, board))
    assert np.abs(a - b).max() < tolerance
    if not isinstance(gridder, KNeighbors):
        outside = spark.createDataFrame([(0.0, 0.0)], "easting double, northing double")
        assert model.transform(outside).first().scalars is None


def test_cubic_is_exact_on_quadratics_inside(spark):
    df = _lattice(spark, (0, 10, 0, 10), (11, 11), lambda e, n: e * n).withColumn("easting", F.col("easting") + 0.01 * F.col("row"))
    df = df.withColumn("scalars", F.col("easting") * 2 - F.col("northing"))
    at = spark.createDataFrame([(3.3, 4.4), (5.5, 5.1)], "easting double, northing double")
    assert [r.scalars for r in Cubic().fit(SpatialFrame(df)).transform(at).collect()] == pytest.approx([2 * 3.3 - 4.4, 2 * 5.5 - 5.1], abs=1e-6)


def test_nearest_reductions_and_facade(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 0.0, 3.0), (9.0, 9.0, 100.0)], "easting double, northing double, scalars double")
    at = spark.createDataFrame([(0.4, 0.0)], "easting double, northing double")
    for reduction, want in (("mean", 2), (np.max, 3), (np.median, 2)):
        assert KNeighbors(2, reduction).fit(SpatialFrame(df)).transform(at).first().scalars == want
    with pytest.warns(FutureWarning):
        facade = ScipyGridder("nearest")
    assert facade.fit(SpatialFrame(df)).transform(at).first().scalars == 1
    with pytest.raises(ValueError), warnings.catch_warnings():
        warnings.simplefilter("ignore")
        ScipyGridder("other").fit(SpatialFrame(df))


def test_projected_grid_and_profile(spark):
    scale = lambda e, n, inverse=False: (e / 10, n / 10) if inverse else (e * 10, n * 10)
    df = _lattice(spark, (0, 100, 0, 100), (11, 11), lambda e, n: e)
    model = Trend(1).fit(SpatialFrame(df))
    grid = model.grid(spark, region=(0, 10, 0, 10), shape=(3, 3), projection=scale)
    assert grid.to_arrays()["scalars"][0].tolist() == pytest.approx([0, 50, 100], abs=1e-6)
    line = model.profile(spark, (0, 0), (10, 0), 3, projection=scale).orderBy("idx").collect()
    assert [r.distance for r in line] == pytest.approx([0, 50, 100]) and [r.easting for r in line] == pytest.approx([0, 5, 10])
    with pytest.raises(ValueError):
        model.grid(spark, shape=(2, 2), coordinates=grid.spec)


@pytest.mark.parametrize("method", ["linear", "nearest", "cubic"])
def test_project_grid(spark, method):
    spec = GridSpec.make((2, 10, -10, -2), shape=(12, 10))
    grid = make_grid(spec, spec.to_df(spark).select("row", "col", F.lit(1.0).alias("ones")))
    out = project_grid(grid, lambda e, n: (e * e, -(n * n)), method=method)
    values = out.to_arrays()["ones"]
    assert out.spec.shape == (12, 10) and out.variables == ("ones",)
    assert np.allclose(values[~np.isnan(values)], 1) and (~np.isnan(values)).sum() > 60
    with pytest.raises(ValueError):
        project_grid(grid, lambda e, n: (e, n), method="other")


def test_selection(spark):
    df = _lattice(spark, (0, 10, -10, -5), (21, 31), lambda e, n: 10 - e + 0.5 * n).withColumn("point_id", F.col("row") * 31 + F.col("col"))
    frame = SpatialFrame(df)
    assert cross_val_score(Trend(1), frame, scoring="r2") == pytest.approx([1] * 5)
    assert cross_val_score(Trend(1), frame, cv=BlockKFold(shape=(3, 3), n_splits=3), scoring="r2") == pytest.approx([1] * 3)
    with pytest.warns(FutureWarning):
        jobs = cross_val_score(Trend(1), frame, delayed=True)
    assert len(jobs) == 5 and jobs[0]() == pytest.approx(1)
    for how in ({}, {"spacing": 2.0}):
        train, test = train_test_split(frame, random_state=3, test_size=0.2, **how)
        assert train.df.count() + test.df.count() == df.count() and train.df.join(test.df, "point_id").count() == 0
    hashed = KFold(4, hashed=True, id_col="point_id").fold(df).groupBy("fold").count().collect()
    assert sum(r["count"] for r in hashed) == df.count() and len(hashed) == 4


_SURFER = "DSAA\n2 6\n1 1000\n2 2000\n11 61\n11 21 31 41 51 61\n61 51 41 31 21 11\n"


def test_surfer(spark, tmp_path):
    grid = load_surfer(spark, io.StringIO(_SURFER))
    assert grid.spec.shape == (2, 6) and grid.attrs == {"gridID": "DSAA"} and grid.spec.region == (2, 2000, 1, 1000)
    path = tmp_path / "a.grd"
    path.write_text(_SURFER.replace("21 11\n", "21 1.70141e38\n"))
    grid = load_surfer(spark, str(path))
    assert np.isnan(grid.to_arrays()["scalars"][1, 5]) and grid.attrs["file"] == str(path)
    spark.dataSource.register(SurferSource)
    assert spark.read.format("surfer").load(str(path)).where("scalars IS NULL").count() == 1
    for bad in (_SURFER.replace("2 6", "6 2"), _SURFER.replace("11 61\n11", "0 61\n11"), "DSAA\nx\n"):
        with pytest.raises(OSError):
            load_surfer(spark, io.StringIO(bad))


def test_stream_of_blocks(spark, tmp_path):
    from gridspark.streaming.blocks import block_counts

    rows = spark.createDataFrame([(1, 0.5, 0.5, 2.0), (2, 0.6, 0.1, 4.0), (3, 1.5, 1.5, 8.0)], "s int, easting double, northing double, scalars double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = block_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), (0, 2, 0, 2), shape=(2, 2))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("blocks_out").start()
    q.processAllAvailable()
    q.stop()
    assert {r.block: (r.n, r.scalars) for r in spark.table("blocks_out").collect()} == {0: (2, 3.0), 3: (1, 8.0)}


def test_exact_spline_of_many_points_is_the_dense_one(spark, monkeypatch):
    from gridspark.plans import splines

    data = CheckerBoard(region=(0, 5000, -5000, 0)).scatter(spark, size=900, random_state=5)
    dense = Spline().fit(SpatialFrame(data))
    for limit in ("MAX_DENSE", "MAX_EXACT"):
        monkeypatch.setattr(splines, limit, 300, raising=False)
    twice = data.unionByName(data.limit(40))  # equal points count once
    model = Spline().fit(SpatialFrame(twice))
    at = data.drop("scalars").unionByName(data.select("point_id", (F.col("northing") - 3).alias("northing"), (F.col("easting") + 7).alias("easting")).select(*data.drop("scalars").columns))
    at = at.unionByName(data.limit(1).select("point_id", F.lit(9e3).alias("northing"), F.lit(-9e3).alias("easting")).select(*data.drop("scalars").columns)).coalesce(2)
    a, b = (m.transform(at).toPandas() for m in (model, dense))
    assert (a[["easting", "northing"]] == b[["easting", "northing"]]).all(None) and len(a) == 1801
    assert np.allclose(a.scalars, b.scalars, rtol=1e-7, atol=1e-4)
    both = data.toPandas().merge(a, on=["easting", "northing"])
    assert len(both) == 900 and np.allclose(both.scalars_x, both.scalars_y, rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("gridder", [Linear(), Cubic()])
def test_interpolators_of_many_points_by_tiles(spark, monkeypatch, gridder):
    from gridspark.operators import geometry
    from gridspark.plans import interpolators

    data = CheckerBoard(region=(1000, 5000, -8000, -6000)).scatter(spark, size=1500, random_state=3)
    at = GridSpec.make((900, 5100, -8100, -5900), shape=(30, 40)).to_df(spark).select("row", "col", "easting", "northing")
    read = lambda m: m.transform(at).orderBy("row", "col").toPandas().scalars
    whole = read(gridder.fit(SpatialFrame(data)))
    for module in (geometry, interpolators):
        monkeypatch.setattr(module, "MAX_TRIANGULATED", 300)
    monkeypatch.setattr(geometry, "PER_TILE", 200, raising=False)
    tiles = read(gridder.fit(SpatialFrame(data)))
    assert len(tiles) == 1200 and 0 < tiles.isna().sum() < 300
    assert np.allclose(whole, tiles, rtol=1e-4, atol=1e-2, equal_nan=True)
