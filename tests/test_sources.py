import lzma

import pytest

from gridspark import datasets
from gridspark.sources.tables import SCHEMAS, read_sample


def test_samples_from_plain_and_packed_csv(spark, tmp_path):
    (tmp_path / "texas-wind.csv").write_text("station_id,longitude,latitude,air_temperature_c,wind_speed_east_knots,wind_speed_north_knots\n0F2,-97.77,33.6,35,-3.2,1.5\n")
    row = datasets.fetch_texas_wind(spark, str(tmp_path)).first()
    assert row.station_id == "0F2" and row.wind_speed_north_knots == 1.5
    with lzma.open(tmp_path / "baja-bathymetry.csv.xz", "wt") as f:
        f.write("longitude,latitude,bathymetry_m\n245.0,27.5,-636.0\n246.0,27.6,\n")
    rows = datasets.fetch_baja_bathymetry(spark, str(tmp_path)).orderBy("longitude").collect()
    assert [r.bathymetry_m for r in rows] == [-636.0, None]
    with pytest.raises(Exception):
        datasets.fetch_rio_magnetic(spark, str(tmp_path))
    with pytest.raises(ValueError):
        read_sample(spark, "other", str(tmp_path))
    assert set(SCHEMAS) == {"texas-wind", "baja-bathymetry", "rio-magnetic", "california-gps"}


def test_folder_setting(spark, monkeypatch):
    monkeypatch.delenv("GRIDSPARK_DATA", raising=False)
    with pytest.raises(ValueError):
        datasets.locate(spark)
    monkeypatch.setenv("GRIDSPARK_DATA", "/data/")
    assert datasets.locate(spark) == "/data"


def test_deprecated_checkerboard():
    with pytest.warns(FutureWarning):
        board = datasets.CheckerBoard(amplitude=5)
    assert board.region_ == (0, 5000, -5000, 0) and board.w_east_ == 2500
