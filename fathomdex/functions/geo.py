"""Distances on the sphere."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8
_UNITS = {"m": 1.0, "km": 1000.0, "mi": 1609.344, "yd": 0.9144, "ft": 0.3048, "nmi": 1852.0, "cm": 0.01}


def metres(distance: str | float) -> float:
    if isinstance(distance, (int, float)):
        return float(distance)
    m = re.fullmatch(r"\s*([0-9.]+)\s*([a-z]*)\s*", distance.lower())
    if not m or (m[2] or "m") not in _UNITS:
        raise ValueError(f"parsing_exception: bad distance {distance!r}")
    return float(m[1]) * _UNITS[m[2] or "m"]


def haversine(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    a = F.pow(F.sin(F.radians(lat - F.lit(lat0)) / 2), 2) + F.cos(F.radians(F.lit(lat0))) * F.cos(F.radians(lat)) * F.pow(F.sin(F.radians(lon - F.lit(lon0)) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.sqrt(a), F.lit(1.0)))
