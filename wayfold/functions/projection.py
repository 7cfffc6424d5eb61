"""Transverse Mercator by Krueger's series, for plane rectangular zones and UTM; degrees to metres and back."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from wayfold.model import ZONE_IX
from wayfold.session import shipping

_POINT = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])


def utm(lon: float) -> dict[str, float]:
    """The zone that holds a longitude, on the WGS84 ellipsoid."""
    zone = min(60, max(1, int((lon + 180) // 6) + 1))
    return {"lat0": 0.0, "lon0": zone * 6 - 183.0, "k0": 0.9996, "a": 6378137.0, "f": 1 / 298.257223563}


class TransverseMercator:
    """One zone; forward gives east and north in metres from its origin."""

    def __init__(self, lat0: float, lon0: float, k0: float, a: float, f: float):
        n = f / (2 - f)
        self.lon0, self.e = math.radians(lon0), math.sqrt(f * (2 - f))
        self.scale = k0 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        self.alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
        self.beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
        self.delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
        self.north0 = 0.0
        self.north0 = float(self.forward(np.array([lon0]), np.array([lat0]))[1][0])

    def forward(self, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = np.sin(np.radians(lat))
        t = np.sinh(np.arctanh(s) - self.e * np.arctanh(self.e * s))
        d = np.radians(lon) - self.lon0
        xi, eta = np.arctan2(t, np.cos(d)), np.arcsinh(np.sin(d) / np.hypot(t, np.cos(d)))
        x, y = eta.copy(), xi.copy()
        for j, c in enumerate(self.alpha, 1):
            x += c * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
            y += c * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        return self.scale * x, self.scale * y - self.north0

    def inverse(self, east: np.ndarray, north: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.asarray(east) / self.scale, (np.asarray(north) + self.north0) / self.scale
        eta, xi = x.copy(), y.copy()
        for j, c in enumerate(self.beta, 1):
            eta -= c * np.cos(2 * j * y) * np.sinh(2 * j * x)
            xi -= c * np.sin(2 * j * y) * np.cosh(2 * j * x)
        chi = np.arcsin(np.sin(xi) / np.cosh(eta))
        lat = chi + sum(c * np.sin(2 * j * chi) for j, c in enumerate(self.delta, 1))
        return np.degrees(self.lon0 + np.arctan2(np.sinh(eta), np.cos(xi))), np.degrees(lat)


@shipping
def to_metres(lon: Column, lat: Column, zone: dict[str, float] = ZONE_IX) -> Column:
    """Degrees to a struct of metres in a zone."""

    @F.pandas_udf(_POINT)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        x, y = TransverseMercator(**zone).forward(a.to_numpy(float), b.to_numpy(float))
        return pd.DataFrame({"x": x, "y": y})

    return run(lon.cast("double"), lat.cast("double"))


@shipping
def to_degrees(x: Column, y: Column, zone: dict[str, float] = ZONE_IX) -> Column:
    """Metres in a zone to a struct of degrees."""

    @F.pandas_udf(_POINT)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        lon, lat = TransverseMercator(**zone).inverse(a.to_numpy(float), b.to_numpy(float))
        return pd.DataFrame({"x": lon, "y": lat})

    return run(x.cast("double"), y.cast("double"))


def padded_bounds(box: tuple[float, float, float, float], kilometres: float) -> tuple[float, float, float, float]:
    """A box in degrees, widened by kilometres in the UTM zone of its middle."""
    w, s, e, n = box
    zone = TransverseMercator(**utm((w + e) / 2))
    x, y = zone.forward(np.array([w, w, e, e]), np.array([s, n, s, n]))
    pad = kilometres * 1000
    lon, lat = zone.inverse(np.array([x.min() - pad, x.min() - pad, x.max() + pad, x.max() + pad]), np.array([y.min() - pad, y.max() + pad, y.min() - pad, y.max() + pad]))
    return float(lon.min()), float(lat.min()), float(lon.max()), float(lat.max())
