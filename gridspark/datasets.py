"""Sample tables under their old names; the checkerboard here is a deprecated alias."""

from __future__ import annotations

import warnings

from gridspark.plans.trend import CheckerBoard as _CheckerBoard
from gridspark.sources.tables import fetch_baja_bathymetry, fetch_california_gps, fetch_rio_magnetic, fetch_texas_wind, locate

__all__ = ["CheckerBoard", "fetch_baja_bathymetry", "fetch_california_gps", "fetch_rio_magnetic", "fetch_texas_wind", "locate"]


class CheckerBoard(_CheckerBoard):
    """Deprecated: use ``gridspark.CheckerBoard``."""

    def __post_init__(self):
        warnings.warn("datasets.CheckerBoard is deprecated: use gridspark.CheckerBoard", FutureWarning, stacklevel=3)
        super().__post_init__()
