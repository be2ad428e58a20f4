"""Distances and weights as column expressions, all inside code generation."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from climekin.plans.spec import SearchSpec, Weight

#: Fixed value: mean radius of the Earth in km.
EARTH_KM = 6371.0088


def euclid(a: list[Column], b: list[Column]) -> Column:
    """Distance over any number of dimensions; products, not powers."""
    if len(a) != len(b) or not a:
        raise ValueError("both points need the same number of coordinates, at least one")
    return F.sqrt(functools.reduce(operator.add, [(x - y) * (x - y) for x, y in zip(a, b)]))


def euclid_arrays(a: Column, b: Column) -> Column:
    """Distance of two array columns of equal length; an error for others."""
    same = F.assert_true(F.size(a) == F.size(b), F.lit("both points need the same number of coordinates"))
    return F.when(same.isNull(), F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance of points in degrees."""
    p, q = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = p * p + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * q * q
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def unit_sphere(lon: Column, lat: Column) -> list[Column]:
    """The point's place on the unit sphere: no wrap and no poles."""
    a, b = F.radians(lon), F.radians(lat)
    return [F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)]


def geographic(lonlat: bool, fx: Column, fy: Column, rx: Column, ry: Column) -> Column:
    """Kilometres for longitude and latitude, else coordinate units."""
    return haversine_km(fx, fy, rx, ry) if lonlat else euclid([fx, fy], [rx, ry])


def weight(spec: SearchSpec, clim: Column, geog: Column) -> Column:
    if spec.weight is Weight.INVERSE_CLIM:
        return F.lit(1.0) / (clim + F.lit(spec.epsilon))
    if spec.weight is Weight.INVERSE_GEOG:
        return F.lit(1.0) / (geog + F.lit(spec.epsilon))
    return F.lit(1.0)
