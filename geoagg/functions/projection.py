"""Web-Mercator projection as column expressions, rounded to FLOAT where results must agree to the bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoagg.options import ClusterOptions

#: Fixed value: the latitude at which the square world ends.
MAX_LATITUDE = 85.0511


def _f(c: Column) -> Column:
    return c.cast("float")


def _d(c: Column) -> Column:
    return c.cast("double")


def project_x(lng: Column, zoom: int, options: ClusterOptions = ClusterOptions()) -> Column:
    return _f((_d(_f(lng)) + 180.0) / 360.0 * options.world(zoom))


def project_y(lat: Column, zoom: int, options: ClusterOptions = ClusterOptions()) -> Column:
    held = F.greatest(F.least(_d(_f(lat)), F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE))
    s = F.sin(held * F.pi() / 180.0)
    share = _f(0.5 - 0.25 * F.log((1.0 + s) / (1.0 - s)) / F.pi())
    return _f(_d(share) * options.world(zoom))


def unproject_lng(x: Column, zoom: int, options: ClusterOptions = ClusterOptions()) -> Column:
    return _f(_d(_f(_d(x) / options.world(zoom))) * 360.0 - 180.0)


def unproject_lat(y: Column, zoom: int, options: ClusterOptions = ClusterOptions()) -> Column:
    share = _d(_f(_d(y) / options.world(zoom)))
    return _f((2.0 * F.atan(F.exp((1.0 - 2.0 * share) * F.pi())) - F.pi() / 2.0) * 180.0 / F.pi())


def tangent_y(lat: Column, zoom: int) -> Column:
    """The log-tangent form with 256-pixel tiles, for comparison."""
    r = _d(lat) * F.pi() / 180.0
    return _f((1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / F.pi()) / 2.0 * float(256 * 2**zoom))


def project_x_sql(lng: str, zoom: int, options: ClusterOptions = ClusterOptions()) -> str:
    """The same in SQL text."""
    return f"cast((cast(cast({lng} as float) as double) + 180e0) / 360e0 * {options.world(zoom)!r}::double as float)"


def project_y_sql(lat: str, zoom: int, options: ClusterOptions = ClusterOptions()) -> str:
    s = f"sin(greatest(least(cast(cast({lat} as float) as double), 85.0511e0), -85.0511e0) * pi() / 180e0)"
    return f"cast(cast(cast(0.5e0 - 0.25e0 * ln((1e0 + {s}) / (1e0 - {s})) / pi() as float) as double) * {options.world(zoom)!r}::double as float)"


def unproject_lng_sql(x: str, zoom: int, options: ClusterOptions = ClusterOptions()) -> str:
    return f"cast(cast(cast(cast({x} as double) / {options.world(zoom)!r}::double as float) as double) * 360e0 - 180e0 as float)"


def unproject_lat_sql(y: str, zoom: int, options: ClusterOptions = ClusterOptions()) -> str:
    share = f"cast(cast(cast({y} as double) / {options.world(zoom)!r}::double as float) as double)"
    return f"cast((2e0 * atan(exp((1e0 - 2e0 * {share}) * pi())) - pi() / 2e0) * 180e0 / pi() as float)"
