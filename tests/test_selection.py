import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark import KFold, Linear, ScipyGridder, Spline, SplineCV, Trend, cross_val_score, train_test_split
from gridspark.functions.columns import checked_latitude, wrap_longitude
from gridspark.operators.geometry import convex_hull
from gridspark.operators.neighbors import within_distance
from gridspark.plans.selection import index_splits
from gridspark.spec import SpatialFrame


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(e), float(n), float(2 * e - n + v)) for k, (e, n, v) in enumerate(zip(*rng.uniform(0, 10, (2, 60)), rng.normal(0, 0.1, 60), strict=True))]
    return spark.createDataFrame(rows, "point_id long, easting double, northing double, scalars double").repartition(4).cache()


class Halves:
    """A splitter by positions, as other libraries have them."""

    def split(self, x):
        west = x[:, 0] < np.median(x[:, 0])
        yield np.flatnonzero(west), np.flatnonzero(~west)
        yield np.flatnonzero(~west), np.flatnonzero(west)


def worst(model, frame):
    out = model.transform(frame.df, frame.coords, ["__p"])
    return -out.agg(F.max(F.abs(F.col("scalars") - F.col("__p")))).first()[0]


def test_scores_by_functions_and_splitters_by_positions(spark, points):
    frame = SpatialFrame(points)
    model = Trend(1).fit(frame)
    assert model.score(frame, worst) == pytest.approx(model.score(frame, "neg_max_error"))
    by_name, by_function = (cross_val_score(Trend(1), frame, cv=Halves(), scoring=s) for s in ("neg_max_error", worst))
    assert len(by_name) == 2 and by_function == pytest.approx(by_name)
    for train, test in index_splits(Halves(), points):
        assert train.count() + test.count() == 60 and {r.point_id for r in train.collect()}.isdisjoint({r.point_id for r in test.collect()})
    jobs = cross_val_score(Trend(1), frame, cv=KFold(3, random_state=1, id_col="point_id"), scoring=worst, delayed=True)
    assert [job() for job in jobs] == pytest.approx(cross_val_score(Trend(1), frame, cv=KFold(3, random_state=1, id_col="point_id"), scoring=worst))


def test_delayed_spline_search_is_the_same(spark, points):
    frame = SpatialFrame(points)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        a, b = (SplineCV(dampings=(None, 1.0), cv=KFold(2, id_col="point_id"), scoring="r2", delayed=d).fit(frame) for d in (False, True))
    assert a.scores_ == pytest.approx(b.scores_) and a.damping_ == b.damping_


def test_hashed_shares(spark, points):
    many = spark.range(20000).select(F.col("id").alias("point_id"), F.rand(1).alias("easting"), F.rand(2).alias("northing"), F.lit(1.0).alias("scalars"))
    train, test = train_test_split(SpatialFrame(many), test_size=0.25, id_col="point_id", hashed=True)
    assert test.df.count() == pytest.approx(5000, abs=200) and train.df.count() + test.df.count() == 20000
    with pytest.raises(ValueError):
        train_test_split(SpatialFrame(many), test_size=100, hashed=True)


def test_options_are_obeyed_or_refused(spark, points):
    with pytest.warns(FutureWarning):
        assert isinstance(ScipyGridder("linear", {"rescale": True}).fit(SpatialFrame(points)), type(Linear(rescale=True).fit(SpatialFrame(points))))
    for method, args in (("linear", {"fill_value": 0}), ("nearest", {"rescale": True})):
        with pytest.raises(ValueError), warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ScipyGridder(method, args).fit(SpatialFrame(points))


def test_geographic_coordinates_are_validated(spark):
    df = spark.createDataFrame([(-180.0, 90.0), (360.0, -90.0), (None, None), (float("nan"), 0.0)], "lon double, lat double")
    assert [r[0] for r in df.select(wrap_longitude(F.col("lon"), True)).collect()][:3] == [180, 0, None]
    assert df.select(checked_latitude(F.col("lat"))).count() == 4
    for lon, lat in ((361.0, 0.0), (0.0, -90.5)):
        bad = spark.createDataFrame([(lon, lat)], "lon double, lat double")
        with pytest.raises(Exception, match="outside"):
            bad.select(wrap_longitude(F.col("lon"), False), checked_latitude(F.col("lat"))).collect()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hulls_and_masks_of_many_partitions(spark, points):
    from itertools import product

    grid = spark.createDataFrame([(float(x), float(y)) for x, y in product(range(8), range(8))], "easting double, northing double").repartition(13)
    assert sorted(convex_hull(grid)) == [(0, 0), (0, 7), (7, 0), (7, 7)]
    rng = np.random.default_rng(1)
    spots, asked = rng.normal(0, 1, (300, 2)).round(2), rng.uniform(-4, 4, (400, 2)).round(2)
    s = spark.createDataFrame(spots.tolist(), "easting double, northing double")
    t = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(asked)], "k int, easting double, northing double")
    got = {r.k: r["mask"] for r in within_distance(t, s, 0.7, ("k",)).collect()}
    assert got == {k: bool((np.hypot(*(spots - x).T) <= 0.7).any()) for k, x in enumerate(asked)}


def test_damped_sums_pass_an_exchange(spark, points):
    side = np.linspace(0, 10, 4)
    forces = np.array([(x, y) for x in side for y in side])
    model = Spline(mindist=0.5, damping=1e-6, force_coords=forces).fit(SpatialFrame(points))
    again = Spline(mindist=0.5, damping=1e-6, force_coords=forces).fit(SpatialFrame(points.coalesce(1)))
    assert model.force_ == pytest.approx(again.force_, rel=1e-5) and model.score(SpatialFrame(points), "r2") > 0.95
