"""Composition of steps: several components, and chains on residuals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from gridspark.operators.blocks import block_mean, block_reduce
from gridspark.plans.base import FittedGridder, Gridder, region_of
from gridspark.plans.trend import Trend
from gridspark.spec import SpatialFrame


class BlockReduce:
    """A block reduction as a step; see ``operators.blocks.block_reduce``."""

    def __init__(self, reduction="mean", **how):
        self.reduction, self.how = reduction, how

    def filter(self, frame: SpatialFrame) -> SpatialFrame:
        return block_reduce(frame, self.reduction, **self.how)


class BlockMean:
    """Block means with weights as a step; see ``operators.blocks.block_mean``."""

    def __init__(self, **how):
        self.how = how

    def filter(self, frame: SpatialFrame) -> SpatialFrame:
        return block_mean(frame, **self.how)


class Vector(Gridder):
    """One gridder per data component. Trends of one degree share a single aggregation."""

    def __init__(self, components):
        self.components = list(components)

    def __repr__(self):
        return f"Vector({self.components})"

    def fit(self, frame: SpatialFrame) -> FittedVector:
        if len(frame.data) != len(self.components):
            raise ValueError(f"{len(self.components)} components can't fit {len(frame.data)} data columns")
        if all(isinstance(c, Trend) for c in self.components) and len({c.degree for c in self.components}) == 1:
            fitted = self.components[0].fit_all(frame)
        else:
            weights = frame.weights or (None,) * len(frame.data)
            fitted = [c.fit(SpatialFrame(frame.df, frame.coords, (d,), None if w is None else (w,))) for c, d, w in zip(self.components, frame.data, weights, strict=True)]
        return FittedVector(components=tuple(fitted), region_=region_of(frame), n_data=len(fitted))


@dataclass(frozen=True, kw_only=True)
class FittedVector(FittedGridder):
    components: tuple

    def transform(self, df, coords=("easting", "northing"), names=None):
        for model, name in zip(self.components, self._names(names), strict=True):
            df = model.transform(df, coords, [name])
        return df


class Chain(Gridder):
    """Steps (name, step): each one's filtered frame feeds the next, predictions add up; block steps only filter."""

    def __init__(self, steps):
        self.steps = list(steps)

    def __repr__(self):
        return f"Chain({self.steps})"

    @property
    def named_steps(self) -> dict:
        return dict(self.steps)

    def fit(self, frame: SpatialFrame) -> FittedChain:
        region, models, n = region_of(frame), [], len(frame.data)
        for k, (_, step) in enumerate(self.steps):
            if isinstance(step, Gridder):
                model = step.fit(frame)
                models.append(model)
                if k + 1 < len(self.steps):
                    frame = model.residuals(frame)
            else:
                frame = step.filter(frame)
        if not models:
            raise ValueError("No step of the chain predicts")
        return FittedChain(models=tuple(models), region_=region, n_data=n)

    def filter(self, frame: SpatialFrame) -> SpatialFrame:
        for _, step in self.steps:
            frame = step.filter(frame)
        return frame


@dataclass(frozen=True, kw_only=True)
class FittedChain(FittedGridder):
    models: tuple

    def transform(self, df, coords=("easting", "northing"), names=None):
        names = self._names(names)
        parts = []
        for k, model in enumerate(self.models):
            own = [f"__{name}_{k}" for name in names]
            df = model.transform(df, coords, own)
            parts.append(own)
        total = {name: sum((F.col(p[j]) for p in parts[1:]), F.col(parts[0][j])) for j, name in enumerate(names)}
        return df.withColumns(total).drop(*[c for p in parts for c in p])
