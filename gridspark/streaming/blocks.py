"""Block reductions over streams: the block key is arithmetic on a fixed region, so nothing but the aggregate has state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators.blocks import block_id, block_lattice


def block_counts(stream: DataFrame, region, coords=("easting", "northing"), data=("scalars",), time_col="ts", window="1 hour", late="10 minutes", spacing=None, shape=None) -> DataFrame:
    """(window start, block, n, means): event-time windows of block means; a fixed region is needed, rows later than ``late`` are dropped."""
    spec = block_lattice(None, coords, spacing, shape, region)
    keyed = stream.withColumn("block", block_id(F.col(coords[0]).cast("double"), F.col(coords[1]).cast("double"), spec, region))
    means = [F.avg(F.nanvl(F.col(d).cast("double"), F.lit(None).cast("double"))).alias(d) for d in data]
    grouped = keyed.withWatermark(time_col, late) if stream.isStreaming else keyed
    return grouped.groupBy(F.window(time_col, window).alias("w"), "block").agg(F.count("*").alias("n"), *means).select(F.col("w.start").alias("start"), "block", "n", *data)
