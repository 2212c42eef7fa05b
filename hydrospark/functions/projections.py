"""Lambert's conformal conic projection with two standard parallels on an ellipsoid, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from math import cos, log, pi, radians, sin, sqrt, tan

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rounds in which a latitude is found back; each gains some two digits.
ROUNDS = 7


@dataclass(frozen=True)
class Conic:
    """Angles in degrees, lengths in metres; the ellipsoid is given by its axis and flattening."""

    axis: float
    flattening: float
    origin: tuple[float, float]  # longitude, latitude
    parallels: tuple[float, float]
    shift: tuple[float, float] = (0.0, 0.0)

    @property
    def e(self) -> float:
        return sqrt(self.flattening * (2 - self.flattening))

    def _t(self, lat: float) -> float:
        s = self.e * sin(lat)
        return tan(pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (self.e / 2)

    @property
    def constants(self) -> tuple[float, float, float]:
        """The cone's constant, the scale, and the radius at the origin."""
        one, two = map(radians, self.parallels)
        m = lambda lat: cos(lat) / sqrt(1 - (self.e * sin(lat)) ** 2)
        n = sin(one) if one == two else (log(m(one)) - log(m(two))) / (log(self._t(one)) - log(self._t(two)))
        f = self.axis * m(one) / (n * self._t(one) ** n)
        return n, f, f * self._t(radians(self.origin[1])) ** n

    def covers(self, lat: Column) -> Column:
        """Whether points of a latitude in degrees come back from the plane: those strictly between the poles."""
        return F.abs(lat) < 90

    def forward(self, lon: Column, lat: Column) -> Column:
        """``struct<x, y>`` of a point in degrees."""
        n, f, r0 = self.constants
        phi, s = F.radians(lat), F.sin(F.radians(lat)) * self.e
        t = F.tan(pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(self.e / 2))
        r, turn = F.pow(t, F.lit(n)) * f, F.radians(lon - self.origin[0]) * n
        return F.struct((r * F.sin(turn) + self.shift[0]).alias("x"), (r0 - r * F.cos(turn) + self.shift[1]).alias("y"))

    def inverse(self, x: Column, y: Column) -> Column:
        """``struct<x, y>`` in degrees of a projected point."""
        n, f, r0 = self.constants
        sign = 1.0 if n > 0 else -1.0
        dx, dy = x - self.shift[0], r0 - (y - self.shift[1])
        r = F.sqrt(dx * dx + dy * dy) * sign
        t = F.pow(r / f, F.lit(1 / n))
        phi = pi / 2 - 2 * F.atan(t)

        def closer(p: Column, _: Column) -> Column:
            s = F.sin(p) * self.e
            return pi / 2 - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(self.e / 2)))

        phi = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), phi, closer)
        return F.struct((F.degrees(F.atan2(dx * sign, dy * sign) / n) + self.origin[0]).alias("x"), F.degrees(phi).alias("y"))


# EPSG:5243, on the ellipsoid GRS 80.
EPSG_5243 = Conic(6378137.0, 1 / 298.257222101, (10.5, 51.0), (48 + 2 / 3, 53 + 2 / 3))
