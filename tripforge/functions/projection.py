"""Transverse Mercator by Krueger's series in the third flattening: degrees to metres and back, as columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients of the series, by power of the third flattening from the row's own to the sixth.
_FORWARD = [
    [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800],
    [13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360],
    [61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440],
    [49561 / 161280, -179 / 168, 6601661 / 7257600],
    [34729 / 80640, -3418889 / 1995840],
    [212378941 / 319334400],
]
_BACK = [
    [1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800],
    [1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720],
    [17 / 480, -37 / 840, -209 / 4480, 5569 / 90720],
    [4397 / 161280, -11 / 504, -830251 / 7257600],
    [4583 / 161280, -108847 / 3991680],
    [20648693 / 638668800],
]


@dataclass(frozen=True)
class Projection:
    """An ellipsoid (half axis and flattening), a meridian and an origin, in degrees, a scale, and what is added in metres."""

    meridian: float
    origin: float = 0.0
    scale: float = 0.9996
    east: float = 500_000.0
    north: float = 0.0
    half_axis: float = 6_378_137.0
    flattening: float = 1 / 298.257223563

    @property
    def third(self) -> float:
        return self.flattening / (2 - self.flattening)

    @property
    def eccentricity(self) -> float:
        return math.sqrt(self.flattening * (2 - self.flattening))

    @property
    def radius(self) -> float:
        """Metres a radian along the meridian, on the average."""
        n = self.third
        return self.scale * self.half_axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)

    def series(self, table: list[list[float]]) -> list[float]:
        return [sum(c * self.third ** (j + k + 1) for k, c in enumerate(row)) for j, row in enumerate(table)]

    @property
    def origin_north(self) -> float:
        """Metres along the meridian from the equator to the origin."""
        s, e = math.sin(math.radians(self.origin)), self.eccentricity
        xi = math.atan(math.sinh(math.atanh(s) - e * math.atanh(e * s)))
        return self.radius * (xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(self.series(_FORWARD))))


def utm(zone: int, south: bool = False) -> Projection:
    """A zone of the universal grid on WGS 84."""
    return Projection(meridian=6.0 * zone - 183.0, north=10_000_000.0 if south else 0.0)


def utm_zone(lng: Column) -> Column:
    """The zone, from 1 to 60, in which a longitude lies; the exceptions of the far north are not made."""
    return (F.pmod(F.floor((lng + 180.0) / 6.0), F.lit(60)) + 1).cast("int")


def _sums(xi: Column, eta: Column, factors: list[float]) -> tuple[Column, Column]:
    x = y = F.lit(0.0)
    for j, a in enumerate(factors, 1):
        x = x + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return x, y


def project(points: DataFrame, projection: Projection, lat: str = "lat", lng: str = "lng", east: str = "x", north: str = "y") -> DataFrame:
    """Add metres east and north. Steps are columns, so each is worked out once a row; unknown degrees give nulls."""
    p, e = projection, projection.eccentricity
    out = points.withColumns({"__s": F.sin(F.radians(lat)), "__l": F.radians(F.col(lng) - p.meridian)})
    out = out.withColumn("__t", F.sinh(F.atanh("__s") - e * F.atanh(e * F.col("__s"))))
    out = out.withColumns({"__xi": F.atan2(F.col("__t"), F.cos("__l")), "__eta": F.asinh(F.sin("__l") / F.hypot(F.col("__t"), F.cos("__l")))})
    x, y = _sums(F.col("__xi"), F.col("__eta"), p.series(_FORWARD))
    out = out.withColumns({east: p.east + p.radius * (F.col("__eta") + y), north: p.north - p.origin_north + p.radius * (F.col("__xi") + x)})
    return out.drop("__s", "__l", "__t", "__xi", "__eta")


def unproject(points: DataFrame, projection: Projection, east: str = "x", north: str = "y", lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Add the degrees of metres east and north. The latitude comes from its conformal one by three of Newton's steps."""
    p, e = projection, projection.eccentricity
    out = points.withColumns({"__xi": (F.col(north) - p.north + p.origin_north) / p.radius, "__eta": (F.col(east) - p.east) / p.radius})
    x, y = _sums(F.col("__xi"), F.col("__eta"), p.series(_BACK))
    out = out.withColumns({"__x": F.col("__xi") - x, "__y": F.col("__eta") - y})
    out = out.withColumn("__goal", F.sin("__x") / F.hypot(F.sinh("__y"), F.cos("__x"))).withColumn("__t", F.col("__goal"))
    for _ in range(3):
        t = F.col("__t")
        out = out.withColumn("__sigma", F.sinh(e * F.atanh(e * t / F.sqrt(1 + t * t))))
        out = out.withColumn("__made", t * F.sqrt(1 + F.col("__sigma") * F.col("__sigma")) - F.col("__sigma") * F.sqrt(1 + t * t))
        slope = (1 + (1 - e * e) * t * t) / ((1 - e * e) * F.sqrt(1 + t * t))
        out = out.withColumn("__t", t + (F.col("__goal") - F.col("__made")) / F.sqrt(1 + F.col("__made") * F.col("__made")) * slope)
    out = out.withColumns({lat: F.degrees(F.atan("__t")), lng: p.meridian + F.degrees(F.atan2(F.sinh("__y"), F.cos("__x")))})
    return out.drop("__xi", "__eta", "__x", "__y", "__goal", "__t", "__sigma", "__made")
