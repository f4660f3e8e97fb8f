"""Surfer ASCII grids (DSAA) as a Spark data source: ``spark.read.format("surfer").load(path)``."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridspark.spec import GridFrame, GridSpec

#: Values from here on stand for "no data".
BLANK = 1.70141e38


def parse_surfer(text: str, axis_order: str = "reference") -> tuple[dict, np.ndarray]:
    """(header, values by row with nan for blanks), checked against the header's shape and range.

    ``axis_order="reference"`` reads the second record as (rows, columns) and the third as the south-north
    range; ``"standard"`` reads columns first and the west-east range first, as the format's own documents do.
    """
    head, _, rest = text.partition("\n")
    lines = [head.strip()]
    for _ in range(4):
        line, _, rest = rest.partition("\n")
        lines.append(line)
    try:
        one, two = (int(v) for v in lines[1].split())
        first, second, found = ([float(v) for v in x.split()] for x in lines[2:5])
        values = [float(v) for v in rest.split()]
    except ValueError as error:
        raise OSError(f"Not a Surfer ASCII grid: {error}") from None
    if axis_order == "standard":
        (ny, nx), (west, east), (south, north) = (two, one), first, second
    else:
        (ny, nx), (south, north), (west, east) = (one, two), first, second
    rows = [len(x.split()) for x in rest.splitlines() if x.strip()]
    shape = (len(rows), rows[0]) if axis_order == "reference" and rows and len(set(rows)) == 1 else (ny, nx) if len(values) == ny * nx else (len(values),)
    if shape != (ny, nx):
        raise OSError(f"The grid has shape {shape}, its header says {(ny, nx)}")
    field = np.array(values).reshape(ny, nx)
    field[field >= BLANK] = np.nan
    if not np.allclose([np.nanmin(field), np.nanmax(field)], found):
        raise OSError(f"Data range {[np.nanmin(field), np.nanmax(field)]} doesn't match {found} of the header")
    return {"gridID": lines[0], "region": (west, east, south, north), "shape": (ny, nx)}, field


def _rows(text: str, axis_order: str):
    head, field = parse_surfer(text, axis_order)
    w, e, s, n = head["region"]
    east, north = np.linspace(w, e, head["shape"][1]), np.linspace(s, n, head["shape"][0])
    for i, y in enumerate(north):
        for j, x in enumerate(east):
            v = field[i, j]
            yield i, j, float(y), float(x), None if math.isnan(v) else float(v)


class SurferReader(DataSourceReader):
    """One partition per file; files are listed and opened through pyarrow's file systems."""

    def __init__(self, options):
        self.path, self.order = options["path"], options.get("axis_order", "reference")

    def _files(self):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path.removeprefix("file:"))
        info = store.get_file_info(at)
        if info.type == fs.FileType.Directory:
            return store, sorted(x.path for x in store.get_file_info(fs.FileSelector(at)) if x.is_file)
        return store, [at]

    def partitions(self):
        return [InputPartition(p) for p in self._files()[1]]

    def read(self, partition):
        store, _ = self._files()
        with store.open_input_stream(partition.value) as f:
            text = f.read().decode()
        for row in _rows(text, self.order):
            yield (*row, partition.value)


class SurferSource(DataSource):
    @classmethod
    def name(cls):
        return "surfer"

    def schema(self):
        return "row int, col int, northing double, easting double, scalars double, file string"

    def reader(self, schema):
        return SurferReader(self.options)


#: Spark types of the values by name.
_DTYPES = {"float64": "double", "double": "double", "float32": "float", "float": "float"}


def load_surfer(spark: SparkSession, source, dtype: str = "float64", axis_order: str = "reference") -> GridFrame:
    """A grid from a path that Spark can read, or from an open text file (left open)."""
    if dtype not in _DTYPES:
        raise ValueError(f"Unknown type {dtype!r}; known: {sorted(_DTYPES)}")
    if hasattr(source, "readline"):
        text, attrs = source.read(), {}
    else:
        rows = spark.read.text(str(source), wholetext=True).collect()
        if len(rows) != 1:
            raise OSError(f"{source} holds {len(rows)} files: use the data source for several")
        text, attrs = rows[0][0], {"file": str(source)}
    head, _ = parse_surfer(text, axis_order)
    w, e, s, n = head["region"]
    spec = GridSpec.make((w, e, s, n), shape=head["shape"])
    df = spark.createDataFrame([(i, j, y, x, v) for i, j, y, x, v in _rows(text, axis_order)], "row int, col int, northing double, easting double, scalars double")
    df = df.withColumn("scalars", df["scalars"].cast(_DTYPES[dtype]))
    return GridFrame(df, spec, ("scalars",), {"gridID": head["gridID"], **attrs})
