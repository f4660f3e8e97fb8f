"""Blocked operators: labels by arithmetic, one aggregation per reduction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.columns import cell_index
from gridspark.spec import GridSpec, SpatialFrame, get_region

TOLERANCE = 1e-15


def block_lattice(df: DataFrame, coords, spacing=None, shape=None, region=None, adjust="spacing") -> GridSpec:
    """The lattice of block centres over ``region`` (the data's own by default)."""
    region = get_region(df, coords) if region is None else region
    return GridSpec.make(region, shape=shape, spacing=spacing, adjust=adjust, pixel_register=True)


def block_bounds(spec: GridSpec) -> tuple[tuple[float, float, int], tuple[float, float, int]]:
    """(start, stop, cells) of the east and the north axis behind a lattice of centres."""
    out = []
    for nodes in (spec.easting, spec.northing):
        half = (nodes[1] - nodes[0]) / 2 if len(nodes) > 1 else 0.0
        out.append((float(nodes[0] - half), float(nodes[-1] + half), len(nodes)))
    return tuple(out)


def block_id(e: Column, n: Column, spec: GridSpec, region=None) -> Column:
    """Row-major label of the block that a point falls in; points beyond the region go to its border blocks.

    The nearest centre of a lattice is found by two floors, so there's no join. ``region``, where the
    blocks fill it, avoids rounding of the borders behind the centres.
    """
    (w, east, nx), (s, north, ny) = block_bounds(spec)
    if region is not None:
        w, east, s, north = (float(v) for v in region)
    return cell_index(n, s, north, ny) * F.lit(nx) + cell_index(e, w, east, nx)


def block_split(df: DataFrame, coords=("easting", "northing"), spacing=None, shape=None, region=None, adjust="spacing") -> tuple[GridSpec, DataFrame]:
    """The lattice of centres, and ``df`` with a column ``block``."""
    region = get_region(df, coords) if region is None else region
    spec = block_lattice(df, coords, spacing, shape, region, adjust)
    return spec, df.withColumn("block", block_id(F.col(coords[0]).cast("double"), F.col(coords[1]).cast("double"), spec, region if adjust == "spacing" else None))


_NAMED = {
    "mean": F.avg, "average": F.avg, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count, "first": F.first, "last": F.last,
    "std": F.stddev_samp, "stddev_samp": F.stddev_samp, "stddev_pop": F.stddev_pop, "var": F.var_samp, "var_samp": F.var_samp, "var_pop": F.var_pop,
}


def _reduce(column: str, reduction, weight: str | None = None) -> Column:
    x = F.col(column)
    if weight is not None:
        if reduction in ("mean", "average"):
            w = F.when(x.isNotNull(), F.col(weight))
            return F.sum(w * x) / F.nullif(F.sum(w), F.lit(0.0))
        if reduction == "sum":
            return F.sum(x * F.col(weight))
        if callable(reduction):
            return _udaf(reduction, 2)(x, F.col(weight))
        raise ValueError(f"No weighted form of reduction {reduction!r}")
    if callable(reduction):
        return _udaf(reduction, 1)(x)
    if reduction not in _NAMED:
        raise ValueError(f"Unknown reduction {reduction!r}; known: {sorted(_NAMED)}")
    return _NAMED[reduction](x).cast("double")


def _udaf(function, inputs: int):
    """A Python reduction as a grouped-aggregate pandas UDF: the slow path, for what has no built-in form."""
    from pyspark.sql.functions import PandasUDFType, pandas_udf

    def reduce_one(values):
        return float(function(values.to_numpy()))

    def reduce_two(values, weights):
        return float(function(values.to_numpy(), weights=weights.to_numpy()))

    return pandas_udf(reduce_one if inputs == 1 else reduce_two, "double", PandasUDFType.GROUPED_AGG)


def _block_coords(frame: SpatialFrame, reduction, center_coordinates: bool, drop_coords: bool):
    """Aggregates of the coordinates, and the columns that centres replace."""
    coords = frame.coords[:2] if drop_coords else frame.coords
    reduced = coords[2:] if center_coordinates else coords
    return coords, [_reduce(c, reduction).alias(c) for c in reduced]


def _centred(df: DataFrame, spec: GridSpec, coords) -> DataFrame:
    nx = spec.shape[1]
    e0, n0 = float(spec.easting[0]), float(spec.northing[0])
    de = float(spec.easting[1] - spec.easting[0]) if nx > 1 else 0.0
    dn = float(spec.northing[1] - spec.northing[0]) if spec.shape[0] > 1 else 0.0
    return df.withColumns({coords[0]: F.lit(e0) + (F.col("block") % nx) * de, coords[1]: F.lit(n0) + F.floor(F.col("block") / nx) * dn})


def block_reduce(frame: SpatialFrame, reduction="mean", spacing=None, region=None, adjust="spacing", center_coordinates=False, shape=None, drop_coords=True) -> SpatialFrame:
    """One row per block that has points: block, reduced coordinates and reduced data; weights are used up.

    Named reductions are one partial and one final hash aggregation; a Python callable is a
    grouped pandas UDF. Nan counts as missing. A block of zero weight has null data.
    """
    spec, df = block_split(frame.clean(), frame.coords, spacing, shape, region, adjust)
    coords, aggregates = _block_coords(frame, reduction, center_coordinates, drop_coords)
    weights = frame.weights or (None,) * len(frame.data)
    aggregates += [_reduce(d, reduction, w).alias(d) for d, w in zip(frame.data, weights, strict=True)]
    out = df.groupBy("block").agg(*aggregates)
    if center_coordinates:
        out = _centred(out, spec, coords)
    return SpatialFrame(out.select("block", *coords, *frame.data), coords, frame.data)


def variance_to_weights(df: DataFrame, variances, weights=None, tolerance: float = TOLERANCE) -> DataFrame:
    """Weights in (0, 1]: the least variance over each one, and 1 where it is within tolerance or missing.

    The least variances are one row, joined back by a broadcast of that row; no single-partition window.
    """
    names = weights or [f"{v}_weight" for v in variances]
    big = lambda v: F.col(v).isNotNull() & ~F.isnan(v) & (F.col(v) > tolerance)
    least = df.agg(*[F.min(F.when(big(v), F.col(v))).alias(f"__least_{k}") for k, v in enumerate(variances)])
    out = df.crossJoin(F.broadcast(least))
    out = out.withColumns({w: F.when(big(v), F.col(f"__least_{k}") / F.col(v)).otherwise(1.0) for k, (v, w) in enumerate(zip(variances, names, strict=True))})
    return out.drop(*[f"__least_{k}" for k in range(len(names))])


def block_mean(frame: SpatialFrame, spacing=None, region=None, adjust="spacing", center_coordinates=False, uncertainty=False, shape=None, drop_coords=True) -> SpatialFrame:
    """Block means with weights in (0, 1] from sample variance, weighted variance, or propagated uncertainty.

    The sums of the weighted variance are centred on the plain mean of all data, one broadcast row: no join on
    the block, which a crowded block would skew. What cancels is (spread / deviation in the block) ** 2 epsilons.
    """
    if uncertainty and frame.weights is None:
        raise ValueError("Uncertainty propagation needs weights")
    spec, df = block_split(frame.clean(), frame.coords, spacing, shape, region, adjust)
    coords, aggregates = _block_coords(frame, "mean", center_coordinates, drop_coords)
    final, shifted = {}, frame.weights is not None and not uncertainty
    if shifted:
        df = df.crossJoin(F.broadcast(df.agg(*[F.coalesce(F.avg(d), F.lit(0.0)).alias(f"__mid_{d}") for d in frame.data])))
    for k, d in enumerate(frame.data):
        x = F.col(d)
        if frame.weights is None:
            aggregates += [F.avg(x).alias(d), F.var_samp(x).alias(f"__v{k}")]
            continue
        w = F.when(x.isNotNull(), F.col(frame.weights[k]))
        if uncertainty:
            aggregates += [(F.sum(w * x) / F.nullif(F.sum(w), F.lit(0.0))).alias(d), (1 / F.nullif(F.sum(w), F.lit(0.0))).alias(f"__v{k}")]
        else:
            y = x - F.col(f"__mid_{d}")
            aggregates += [F.sum(w).alias(f"__w{k}"), F.sum(w * y).alias(f"__s{k}"), F.sum(w * y * y).alias(f"__q{k}"), F.first(f"__mid_{d}").alias(f"__m{k}")]
            total = F.nullif(F.col(f"__w{k}"), F.lit(0.0))
            mean = F.col(f"__s{k}") / total
            final[d] = F.col(f"__m{k}") + mean
            final[f"__v{k}"] = F.greatest(F.col(f"__q{k}") / total - mean * mean, F.lit(0.0))
    out = df.groupBy("block").agg(*aggregates).withColumns(final)
    if center_coordinates:
        out = _centred(out, spec, coords)
    weights = tuple(f"{d}_weight" for d in frame.data)
    out = variance_to_weights(out, [f"__v{k}" for k in range(len(frame.data))], list(weights))
    return SpatialFrame(out.select("block", *coords, *frame.data, *weights), coords, frame.data, weights)


def minmax(df: DataFrame, columns, nan=True, min_percentile=0, max_percentile=100) -> DataFrame:
    """One row (minimum, maximum) or percentiles with linear interpolation over all the columns together."""
    for p in (min_percentile, max_percentile):
        if not 0 <= p <= 100:
            raise ValueError(f"A percentile lies in 0..100, not {p}")
    return _over_all(df, columns, nan, lambda x: x, (min_percentile, max_percentile)).select(F.col("low").alias("minimum"), F.col("high").alias("maximum"))


def maxabs(df: DataFrame, columns, nan=True, percentile=100) -> DataFrame:
    """One row (maxabs): largest absolute value, or its percentile, over all the columns together."""
    if not 0 <= percentile <= 100:
        raise ValueError(f"A percentile lies in 0..100, not {percentile}")
    return _over_all(df, columns, nan, F.abs, (0, percentile)).select(F.col("high").alias("maxabs"))


def _over_all(df: DataFrame, columns, nan, change, percentiles) -> DataFrame:
    """One row (low, high): two percentiles of all values; nan if one is nan and that counts."""
    x = F.col("x")
    values = df.select(F.explode(F.array(*[F.col(c).cast("double") for c in columns])).alias("x")).where("x IS NOT NULL")
    flag = F.lit(False) if nan else F.coalesce(F.max(F.isnan(x)), F.lit(False))
    values = values.select(change(x).alias("x"))
    if nan:
        values = values.where(~F.isnan(x))
    pick = lambda p: F.min(x) if p == 0 else F.max(x) if p == 100 else F.percentile(x, F.lit(p / 100))
    lost = F.lit(float("nan"))
    low, high = (F.when(flag, lost).otherwise(pick(p)) for p in percentiles)
    return values.agg(low.alias("low"), high.alias("high"))
