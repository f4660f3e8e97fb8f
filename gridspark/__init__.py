"""Scattered two-dimensional observations to regular grids, on Spark DataFrames."""

from gridspark.functions.columns import inside, longitude_region, mercator, wrap_longitude
from gridspark.operators.blocks import block_mean, block_reduce, block_split, maxabs, minmax, variance_to_weights
from gridspark.operators.geometry import convexhull_mask, distance_mask
from gridspark.operators.neighbors import knn_join, median_distance
from gridspark.operators.windows import expanding_window, rolling_window, window_lists
from gridspark.plans.compose import BlockMean, BlockReduce, Chain, Vector
from gridspark.plans.interpolators import Cubic, KNeighbors, Linear, ScipyGridder
from gridspark.plans.projections import project_coordinates, project_grid, project_region
from gridspark.plans.selection import BlockKFold, BlockShuffleSplit, KFold, cross_val_score, partition_by_sum, train_test_split
from gridspark.plans.splines import Spline, SplineCV, VectorSpline2D
from gridspark.plans.trend import CheckerBoard, Trend
from gridspark.sources.surfer import SurferSource, load_surfer
from gridspark.sources.tables import fetch_baja_bathymetry, fetch_california_gps, fetch_rio_magnetic, fetch_texas_wind, locate
from gridspark.spec import (
    GridFrame,
    GridSpec,
    SpatialFrame,
    check_region,
    get_region,
    line_coordinates,
    make_grid,
    pad_region,
    profile_coordinates,
    scatter_points,
    shape_to_spacing,
    spacing_to_size,
)

__all__ = [
    "BlockKFold", "BlockMean", "BlockReduce", "BlockShuffleSplit", "Chain", "CheckerBoard", "Cubic", "GridFrame", "GridSpec", "KFold", "KNeighbors", "Linear", "ScipyGridder",
    "SpatialFrame", "Spline", "SplineCV", "SurferSource", "Trend", "Vector", "VectorSpline2D", "block_mean", "block_reduce", "block_split", "check_region", "convexhull_mask",
    "cross_val_score", "distance_mask", "expanding_window", "fetch_baja_bathymetry", "fetch_california_gps", "fetch_rio_magnetic", "fetch_texas_wind", "get_region", "inside",
    "knn_join", "line_coordinates", "load_surfer", "locate", "longitude_region", "make_grid", "maxabs", "median_distance", "mercator", "minmax", "pad_region", "partition_by_sum",
    "profile_coordinates", "project_coordinates", "project_grid", "project_region", "rolling_window", "scatter_points", "shape_to_spacing", "spacing_to_size", "train_test_split",
    "variance_to_weights", "window_lists", "wrap_longitude",
]
