"""Polynomial trends and the checkerboard model."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from gridspark.functions.columns import checkerboard
from gridspark.plans.base import FittedGridder, Gridder, region_of
from gridspark.plans.solve import Moments, terms
from gridspark.spec import SpatialFrame


@dataclass(frozen=True)
class Trend(Gridder):
    """Two-dimensional polynomial fitted by weighted least squares from one pass of power sums."""

    degree: int

    def __post_init__(self):
        terms(self.degree)

    def fit(self, frame: SpatialFrame) -> FittedTrend:
        return self.fit_all(frame)[0] if len(frame.data) == 1 else self._several()

    def fit_all(self, frame: SpatialFrame) -> list[FittedTrend]:
        """A trend for every component, from one shared aggregation."""
        region = region_of(frame)
        moments = Moments(self.degree, region)
        row = frame.clean().agg(*moments.aggregates(frame.coords, frame.data, frame.weights)).first().asDict()
        return [FittedTrend(degree=self.degree, coef_=moments.coefficients(row, k, frame.weights is not None), region_=region) for k in range(len(frame.data))]

    def _several(self):
        raise ValueError("A trend has one data component; use Vector for more")


@dataclass(frozen=True, kw_only=True)
class FittedTrend(FittedGridder):
    degree: int
    coef_: np.ndarray

    def transform(self, df, coords=("easting", "northing"), names=None):
        e, n = (F.col(c).cast("double") for c in coords[:2])
        total = F.lit(0.0)
        for c, (i, j) in zip(self.coef_, terms(self.degree), strict=True):
            term = F.lit(float(c))
            for _ in range(i):
                term = term * e
            for _ in range(j):
                term = term * n
            total = total + term
        return df.withColumn(self._names(names)[0], total)


@dataclass(frozen=True)
class CheckerBoard(FittedGridder):
    """Synthetic model: a product of a sine and a cosine; predicts without a fit."""

    amplitude: float = 1000.0
    region: tuple = (0.0, 5000.0, -5000.0, 0.0)
    w_east: float | None = None
    w_north: float | None = None

    def __post_init__(self):
        from gridspark.spec import check_region

        object.__setattr__(self, "region_", check_region(self.region))

    @property
    def w_east_(self) -> float:
        return (self.region_[1] - self.region_[0]) / 2 if self.w_east is None else self.w_east

    @property
    def w_north_(self) -> float:
        return (self.region_[3] - self.region_[2]) / 2 if self.w_north is None else self.w_north

    def transform(self, df, coords=("easting", "northing"), names=None):
        e, n = (F.col(c).cast("double") for c in coords[:2])
        return df.withColumn(self._names(names)[0], checkerboard(e, n, self.amplitude, self.w_east_, self.w_north_))

    def scatter(self, spark, region=None, size=300, random_state=0, names=None, projection=None, extra_coords=None):
        """Synthetic data at random points."""
        return self._scatter(spark, region, size, random_state, names, projection, extra_coords)
