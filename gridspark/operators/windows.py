"""Spatial windows: memberships from lattice arithmetic, not from a theta join."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.spec import GridSpec, check_region, get_region


def window_lattice(region, size: float, spacing=None, shape=None, adjust="spacing") -> GridSpec:
    """Centres of square windows that stay inside ``region``."""
    w, e, s, n = check_region(region)
    if size > min(e - w, n - s):
        raise ValueError(f"A window of size {size} is larger than the region {region}")
    half = size / 2
    spec = GridSpec.make((w + half, e - half, s + half, n - half), shape=shape, spacing=spacing, adjust=adjust)
    steps = [nodes[1] - nodes[0] for nodes in (spec.easting, spec.northing) if len(nodes) > 1]
    if any(step > size and not math.isclose(step, size) for step in steps):
        warnings.warn(f"Windows of size {size} don't overlap at steps {steps}", UserWarning, stacklevel=3)
    return spec


def rolling_window(df: DataFrame, size: float, id_col: str = "point_id", coords=("easting", "northing"), spacing=None, shape=None, region=None, adjust="spacing") -> tuple[GridSpec, DataFrame]:
    """Lattice of centres, and memberships (win_row, win_col, center_e, center_n, id).

    A point computes the lattice interval within half a window of it on both axes and explodes that:
    work grows with memberships only. An exact comparison with the centre follows, so rounding of
    the interval can't add or lose a border point.
    """
    region = get_region(df, coords) if region is None else region
    spec = window_lattice(region, size, spacing, shape, adjust)
    half = F.lit(size / 2)
    out = df.select(F.col(id_col), F.col(coords[0]).cast("double").alias("__e"), F.col(coords[1]).cast("double").alias("__n"))
    for x, nodes, index, center in (("__n", spec.northing, "win_row", "center_n"), ("__e", spec.easting, "win_col", "center_e")):
        start, count = float(nodes[0]), len(nodes)
        step = float(nodes[-1] - nodes[0]) / (count - 1) if count > 1 else 0.0
        if step > 0:
            low = F.greatest(F.ceil((F.col(x) - half - start) / step - 1e-6), F.lit(0))
            high = F.least(F.floor((F.col(x) + half - start) / step + 1e-6), F.lit(count - 1))
            out = out.where(low <= high).withColumn(index, F.explode(F.sequence(low.cast("int"), high.cast("int"))))
        else:
            out = out.withColumn(index, F.lit(0))
        value = F.when(F.col(index) == count - 1, F.lit(float(nodes[-1]))).otherwise(F.lit(start) + F.col(index) * step)
        out = out.withColumn(center, value).where(F.abs(F.col(x) - F.col(center)) <= half * (1 + 1e-12))
    return spec, out.select("win_row", "win_col", "center_e", "center_n", id_col)


def window_lists(spec: GridSpec, members: DataFrame, id_col: str = "point_id") -> DataFrame:
    """One row per window, empty ones too: sorted ids as an array. For windows of bounded content."""
    lattice = spec.to_df(members.sparkSession).select(F.col("row").alias("win_row"), F.col("col").alias("win_col"), F.col(spec.dims[1]).alias("center_e"), F.col(spec.dims[0]).alias("center_n"))
    lists = members.groupBy("win_row", "win_col").agg(F.array_sort(F.collect_list(id_col)).alias("ids"))
    empty = F.array().cast(lists.schema["ids"].dataType)
    return lattice.join(lists, ["win_row", "win_col"], "left").withColumn("ids", F.coalesce("ids", empty))


def expanding_window(df: DataFrame, center, sizes, id_col: str = "point_id", coords=("easting", "northing")) -> DataFrame:
    """Memberships (win, size, id) of square windows around one point, in the order of ``sizes``: one scan."""
    e, n = F.col(coords[0]).cast("double"), F.col(coords[1]).cast("double")
    reach = F.greatest(F.abs(e - float(center[0])), F.abs(n - float(center[1])))
    windows = F.array(*[F.struct(F.lit(k).alias("win"), F.lit(float(s)).alias("size")) for k, s in enumerate(sizes)])
    largest = float(max(sizes))
    w = F.explode(F.filter(windows, lambda x: F.lit(2.0) * reach <= x["size"]))
    return df.where(F.lit(2.0) * reach <= largest).select(w.alias("w"), id_col).select("w.win", "w.size", id_col)
