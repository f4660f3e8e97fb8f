"""Regions, coordinates and grids under projections of Columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators.geometry import convexhull_mask
from gridspark.plans.base import Gridder
from gridspark.plans.compose import BlockReduce, Chain
from gridspark.plans.interpolators import Cubic, KNeighbors, Linear
from gridspark.spec import GridFrame, GridSpec, Region, SpatialFrame, check_region, get_region, shape_to_spacing


def project_coordinates(df: DataFrame, projection, coords=("easting", "northing")) -> DataFrame:
    """The first two coordinates projected, everything else as it is."""
    e, n = projection(F.col(coords[0]), F.col(coords[1]))
    return df.withColumns({coords[0]: e, coords[1]: n})


def project_region(spark: SparkSession, region, projection) -> Region:
    """Bounding box of a projected region, from a lattice of 101 x 101 nodes."""
    return get_region(project_coordinates(GridSpec.make(region, shape=(101, 101)).to_df(spark), projection))


def project_grid(grid: GridFrame, projection, method="linear", antialias=True, region=None, shape=None, spacing=None, names=None, **how) -> GridFrame:
    """A regular grid in projected coordinates from one variable of ``grid``.

    Nodes with data are projected, averaged by blocks against aliasing, interpolated, and masked
    outside their convex hull.
    """
    if len(grid.variables) != 1:
        raise ValueError(f"A grid of one variable is needed, not {len(grid.variables)}")
    if isinstance(method, str):
        kinds = {"linear": Linear, "nearest": KNeighbors, "cubic": Cubic}
        if method not in kinds:
            raise ValueError(f"Invalid interpolation method {method!r}; known: {sorted(kinds)}")
        method = kinds[method]()
    elif not isinstance(method, Gridder):
        raise ValueError(f"A method is a name or a gridder, not {method!r}")
    name = grid.variables[0]
    dims = grid.spec.dims
    e, n = projection(F.col(dims[1]), F.col(dims[0]))
    points = grid.dropna().select(e.alias("easting"), n.alias("northing"), F.col(name))
    data_region = get_region(points)
    region = check_region(data_region if region is None else region)
    shape = grid.spec.shape if shape is None else shape
    spacing = shape_to_spacing(region, shape) if spacing is None else spacing
    steps = [("mean", BlockReduce("mean", spacing=spacing, region=data_region))] if antialias else []
    model = Chain([*steps, ("interpolator", method)]).fit(SpatialFrame(points, data=(name,)))
    projected = model.grid(points.sparkSession, region=region, spacing=spacing, names=names or [name], **how)
    return convexhull_mask(points, grid=projected)
