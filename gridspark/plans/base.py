"""Gridders: ``fit`` runs a job and gives an immutable model; everything a model does is lazy."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.plans.solve import metric
from gridspark.spec import GridFrame, GridSpec, Region, SpatialFrame, data_names, get_region, profile_coordinates, scatter_points


class Gridder(ABC):
    """Parameters of a method; ``fit`` returns what predicts."""

    @abstractmethod
    def fit(self, frame: SpatialFrame) -> FittedGridder: ...

    def filter(self, frame: SpatialFrame) -> SpatialFrame:
        """Residuals in place of the data; coordinates and weights stay."""
        return self.fit(frame).residuals(frame)


@dataclass(frozen=True, kw_only=True)
class FittedGridder(ABC):
    region_: Region | None = None
    n_data: int = 1

    @abstractmethod
    def transform(self, df: DataFrame, coords=("easting", "northing"), names=None) -> DataFrame:
        """``df`` with a column of predictions per component."""

    def _names(self, names=None) -> list[str]:
        return data_names(self.n_data, names)

    def residuals(self, frame: SpatialFrame) -> SpatialFrame:
        predicted = [f"__p{k}" for k in range(len(frame.data))]
        df = self.transform(frame.df, frame.coords, predicted)
        return frame.on(df.withColumns({d: F.col(d) - F.col(p) for d, p in zip(frame.data, predicted, strict=True)}).drop(*predicted))

    def score(self, frame: SpatialFrame, scoring: str | Callable | None = None) -> float:
        """R squared by default, averaged over components; a function gets the fitted gridder and the frame."""
        if scoring is None:
            warnings.warn("The default score will become the negative root mean squared error", FutureWarning, stacklevel=2)
            scoring = "r2"
        if callable(scoring):
            return float(scoring(self, frame))
        predicted = [f"__p{k}" for k in range(len(frame.data))]
        return metric(self.transform(frame.clean(), frame.coords, predicted), scoring, frame.data, predicted, frame.weights)

    def _region(self, region) -> Region:
        if region is None and self.region_ is None:
            raise ValueError("No default region: give one")
        return self.region_ if region is None else region

    def grid(self, spark: SparkSession, region=None, shape=None, spacing=None, dims=("northing", "easting"), names=None, projection=None, coordinates: GridSpec | None = None, **how) -> GridFrame:
        """Predictions on a lattice. A projection applies to what is predicted at, not to the grid's coordinates."""
        if coordinates is not None:
            if region is not None or shape is not None or spacing is not None:
                raise ValueError("Give coordinates, or region with shape or spacing, not both")
            spec = coordinates
        else:
            spec = GridSpec.make(self._region(region), shape=shape, spacing=spacing, dims=dims, **how)
        names = self._names(names)
        df = spec.to_df(spark)
        at = (spec.dims[1], spec.dims[0])
        if projection is not None:
            e, n = projection(F.col(at[0]), F.col(at[1]))
            df, at = df.withColumns({"__e": e, "__n": n}), ("__e", "__n")
        out = self.transform(df, at, names).select("row", "col", *spec.dims, *spec.extras, *names)
        return GridFrame(out, spec, tuple(names), {"metadata": f"Generated by {self!r}"})

    def profile(self, spark: SparkSession, point1, point2, size: int, names=None, projection=None, extra_coords=None) -> DataFrame:
        """Predictions on a line: northing, easting, distance, extras, data.

        With a projection (``projection(e, n, inverse=False)`` on Columns) the line is straight in projected
        space, distances are projected, coordinates come back unprojected.
        """
        if projection is not None:
            ends = spark.createDataFrame([(0, *map(float, point1)), (1, *map(float, point2))], "k int, e double, n double")
            e, n = projection(F.col("e"), F.col("n"))
            point1, point2 = ((r["pe"], r["pn"]) for r in ends.select("k", e.alias("pe"), n.alias("pn")).orderBy("k").collect())
        line = profile_coordinates(spark, point1, point2, size, extra_coords)
        names = self._names(names)
        out = self.transform(line, ("easting", "northing"), names)
        if projection is not None:
            e, n = projection(F.col("easting"), F.col("northing"), inverse=True)
            out = out.withColumns({"easting": e, "northing": n})
        extras = [c for c in line.columns if c.startswith("extra_coord")]
        return out.select("idx", "northing", "easting", "distance", *extras, *names)

    def scatter(self, spark: SparkSession, region=None, size=300, random_state=0, names=None, projection=None, extra_coords=None) -> DataFrame:
        """Deprecated: predictions at random points."""
        warnings.warn("scatter is deprecated: use scatter_points and transform", FutureWarning, stacklevel=2)
        return self._scatter(spark, region, size, random_state, names, projection, extra_coords)

    def _scatter(self, spark, region=None, size=300, random_state=0, names=None, projection=None, extra_coords=None) -> DataFrame:
        df, at = scatter_points(spark, self._region(region), size, random_state, extra_coords), ("easting", "northing")
        extras = [c for c in df.columns if c.startswith("extra_coord")]
        names = self._names(names)
        if projection is not None:
            e, n = projection(F.col("easting"), F.col("northing"))
            df, at = df.withColumns({"__e": e, "__n": n}), ("__e", "__n")
        return self.transform(df, at, names).select("point_id", "northing", "easting", *extras, *names)


def region_of(frame: SpatialFrame) -> Region:
    return get_region(frame.df, frame.coords)
