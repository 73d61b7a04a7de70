"""The spherical predicates as DataFrame columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sphere


def distance(ra1: str, dec1: str, ra2: str, dec2: str) -> Column:
    """Angular distance in degrees; arguments are SQL expressions."""
    return F.expr(sphere.hav(ra1, dec1, ra2, dec2))


def cone_contains(ra: str, dec: str, ra0: float | str, dec0: float | str, radius: float | str) -> Column:
    if all(isinstance(x, (int, float)) for x in (ra0, dec0, radius)):
        if radius < 0:
            return F.lit(False)
        return F.expr(sphere.cone_literal(ra, dec, float(ra0), float(dec0), float(radius)))
    return F.expr(sphere.cone(ra, dec, str(ra0), str(dec0), str(radius)))


def polygon_contains(ra: str, dec: str, vertices: list[tuple[float, float]]) -> Column:
    cap = sphere.bounding_cap(vertices)
    inside = F.expr(sphere.point_in_polygon(ra, dec, sphere.literal_polygon(vertices)))
    return inside if cap[2] >= 180 else F.expr(sphere.cone_literal(ra, dec, *cap)) & inside


def region_contains(ra: str, dec: str, region: str) -> Column:
    return F.expr(sphere.point_in_polygon(ra, dec, sphere.parse_region(region)))
