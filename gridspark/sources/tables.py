"""Sample tables as scans with declared schemas; folders come from the caller or the session."""

from __future__ import annotations

import lzma
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "texas-wind": "station_id string, longitude double, latitude double, air_temperature_c double, wind_speed_east_knots double, wind_speed_north_knots double",
    "baja-bathymetry": "longitude double, latitude double, bathymetry_m double",
    "rio-magnetic": "longitude double, latitude double, total_field_anomaly_nt double, height_ell_m double, line_type string, line_number bigint",
    "california-gps": "latitude double, longitude double, height double, velocity_north double, velocity_east double, velocity_up double, std_north double, std_east double, std_up double",
}


def locate(spark: SparkSession) -> str:
    """Folder of the sample tables: ``spark.gridspark.data`` of the session, or GRIDSPARK_DATA."""
    folder = spark.conf.get("spark.gridspark.data", None) or os.environ.get("GRIDSPARK_DATA")
    if not folder:
        raise ValueError("Set spark.gridspark.data or GRIDSPARK_DATA to the folder of the sample tables")
    return folder.rstrip("/")


def read_sample(spark: SparkSession, name: str, folder: str | None = None) -> DataFrame:
    """A sample table by name. Plain CSV is scanned by Spark; ``.csv.xz``, which Spark has no codec for, by task."""
    if name not in SCHEMAS:
        raise ValueError(f"Unknown table {name!r}; known: {sorted(SCHEMAS)}")
    folder = locate(spark) if folder is None else folder
    reader = spark.read.schema(SCHEMAS[name]).option("header", True)
    try:
        return reader.csv(f"{folder}/{name}.csv")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        packed = spark.read.format("binaryFile").load(f"{folder}/{name}.csv.xz")
        if not packed.limit(1).count():
            raise missing
        lines = packed.select("content").rdd.flatMap(lambda r: lzma.decompress(bytes(r[0])).decode().splitlines())
        return reader.csv(lines)


def fetch_texas_wind(spark: SparkSession, folder: str | None = None) -> DataFrame:
    return read_sample(spark, "texas-wind", folder)


def fetch_baja_bathymetry(spark: SparkSession, folder: str | None = None) -> DataFrame:
    return read_sample(spark, "baja-bathymetry", folder)


def fetch_rio_magnetic(spark: SparkSession, folder: str | None = None) -> DataFrame:
    return read_sample(spark, "rio-magnetic", folder)


def fetch_california_gps(spark: SparkSession, folder: str | None = None) -> DataFrame:
    return read_sample(spark, "california-gps", folder)
