"""World coordinates: linear steps, zenithal and CAR projections, spherical rotation, spectral axes."""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BadWcs, NonInvertible, UnsupportedProjection

R0 = 180.0 / math.pi
PROJECTIONS = ("TAN", "SIN", "ARC", "STG", "ZEA", "CAR")


def matrix(cdelt=(1.0, 1.0), pc=None, cd=None, crota: float | None = None) -> list[list[float]]:
    """The linear step's matrix: CD, or CDELT times PC, or CDELT turned by the older CROTA."""
    if cd is not None and pc is not None:
        raise BadWcs("both CD and PC")
    if cd is not None:
        return [list(map(float, r)) for r in cd]
    if crota is not None and pc is None:
        c, s = math.cos(math.radians(crota)), math.sin(math.radians(crota))
        return [[cdelt[0] * c, -cdelt[1] * s], [cdelt[0] * s, cdelt[1] * c]]
    pc = pc or [[1.0, 0.0], [0.0, 1.0]]
    return [[cdelt[i] * pc[i][j] for j in range(2)] for i in range(2)]


@dataclasses.dataclass
class Celestial:
    """A pair of celestial axes; everything in degrees."""

    crpix: tuple[float, float]
    crval: tuple[float, float]
    m: list[list[float]]
    projection: str = "TAN"
    lonpole: float | None = None
    latpole: float | None = None
    swapped: bool = False

    def __post_init__(self):
        if self.projection not in PROJECTIONS:
            raise UnsupportedProjection(self.projection)
        self.pole = pole(self.crval, self.projection, self.lonpole, self.latpole)

    def inverse(self) -> list[list[float]]:
        (a, b), (c, d) = self.m
        det = a * d - b * c
        if det == 0 or not math.isfinite(det):
            raise NonInvertible("the matrix has no inverse")
        return [[d / det, -b / det], [-c / det, a / det]]


def pole(crval, projection: str, lonpole: float | None, latpole: float | None) -> tuple[float, float, float]:
    """(longitude, latitude of the native pole, native longitude of the celestial pole), in radians."""
    a0, d0 = map(math.radians, crval)
    theta0 = 0.0 if projection == "CAR" else 90.0
    phi = math.radians(lonpole if lonpole is not None else (0.0 if crval[1] >= theta0 else 180.0))
    if projection != "CAR":
        return a0, d0, phi
    # The reference point is on the native equator: its pole's latitude solves sin(d0) = cos(dp) cos(phi).
    base = math.atan2(0.0, math.cos(phi))
    span = math.acos(max(-1.0, min(1.0, math.sin(d0) / math.hypot(math.cos(phi), 0.0)))) if abs(math.cos(phi)) > 1e-12 else math.pi / 2
    want = math.radians(latpole if latpole is not None else 90.0)
    roots = [x for x in (base + span, base - span) if abs(x) <= math.pi / 2 + 1e-9] or [math.pi / 2]
    dp = min(roots, key=lambda x: abs(x - want))
    if abs(math.cos(d0)) < 1e-12:
        ap = a0
    elif abs(abs(dp) - math.pi / 2) < 1e-12:
        ap = a0 + (phi - math.pi if dp > 0 else -phi)
    else:
        y, x = math.sin(phi) / math.cos(d0), -math.sin(dp) * math.sin(d0) / (math.cos(dp) * math.cos(d0))
        ap = a0 - math.atan2(y, x)
    return ap, dp, phi


def to_cards(w: Celestial, axes: tuple[str, str] = ("RA", "DEC"), alternative: str = "") -> list[tuple[str, object]]:
    """The keywords that describe a pair of celestial axes, with the matrix as CD."""
    a = alternative
    names = axes[::-1] if w.swapped else axes
    crval = w.crval[::-1] if w.swapped else w.crval
    out: list[tuple[str, object]] = [(f"WCSAXES{a}", 2)]
    for i in (1, 2):
        kind = names[i - 1] + "-" * (8 - len(names[i - 1]) - len(w.projection)) + w.projection
        out += [(f"CTYPE{i}{a}", kind), (f"CUNIT{i}{a}", "deg"), (f"CRPIX{i}{a}", float(w.crpix[i - 1])), (f"CRVAL{i}{a}", float(crval[i - 1]))]
    out += [(f"CD{i}_{j}{a}", float(w.m[i - 1][j - 1])) for i in (1, 2) for j in (1, 2)]
    return out + [(f"{k}{a}", float(v)) for k, v in (("LONPOLE", w.lonpole), ("LATPOLE", w.latpole)) if v is not None]


def linear(p1: Column, p2: Column, w: Celestial) -> tuple[Column, Column]:
    """Intermediate world coordinates of a pixel; pixels count from 1."""
    x, y = p1 - F.lit(float(w.crpix[0])), p2 - F.lit(float(w.crpix[1]))
    m = w.m
    return F.lit(m[0][0]) * x + F.lit(m[0][1]) * y, F.lit(m[1][0]) * x + F.lit(m[1][1]) * y


def deproject(x: Column, y: Column, projection: str) -> tuple[Column, Column]:
    """Native longitude and latitude in radians; null outside of the projection's plane."""
    r = F.hypot(x, y)
    if projection == "CAR":
        return F.radians(x), F.radians(y)
    phi = F.when(r == 0, F.lit(0.0)).otherwise(F.atan2(x, -y))
    half = F.lit(math.pi / 2)
    theta = {
        "TAN": lambda: F.atan2(F.lit(R0), r),
        "SIN": lambda: F.when(r <= R0, F.acos(F.least(r / R0, F.lit(1.0)))),
        "ARC": lambda: F.when(r <= 180, F.radians(F.lit(90.0) - r)),
        "STG": lambda: half - 2 * F.atan(r / (2 * R0)),
        "ZEA": lambda: F.when(r <= 2 * R0, half - 2 * F.asin(F.least(r / (2 * R0), F.lit(1.0)))),
    }[projection]()
    return phi, theta


def project(phi: Column, theta: Column, projection: str) -> tuple[Column, Column]:
    """Projection plane coordinates in degrees; null where the projection diverges."""
    if projection == "CAR":
        return F.degrees(phi), F.degrees(theta)
    half = F.lit(math.pi / 2)
    r = {
        "TAN": lambda: F.when(theta > 0, F.lit(R0) / F.tan(theta)),
        "SIN": lambda: F.when(theta >= 0, F.lit(R0) * F.cos(theta)),
        "ARC": lambda: F.lit(90.0) - F.degrees(theta),
        "STG": lambda: F.lit(2 * R0) * F.tan((half - theta) / 2),
        "ZEA": lambda: F.lit(2 * R0) * F.sin((half - theta) / 2),
    }[projection]()
    return r * F.sin(phi), -r * F.cos(phi)


def to_celestial(phi: Column, theta: Column, p: tuple[float, float, float]) -> tuple[Column, Column]:
    """Longitude in [0, 360) and latitude, in degrees."""
    ap, dp, pp = p
    s, c, turn = F.sin(theta), F.cos(theta), phi - F.lit(pp)
    lat = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s * math.sin(dp) + c * math.cos(dp) * F.cos(turn))))
    lon = F.lit(ap) + F.atan2(-c * F.sin(turn), s * math.cos(dp) - c * math.sin(dp) * F.cos(turn))
    degrees = F.degrees(lon)
    return degrees - F.floor(degrees / 360.0) * 360.0, F.degrees(lat)


def to_native(lon: Column, lat: Column, p: tuple[float, float, float]) -> tuple[Column, Column]:
    """Native longitude and latitude in radians."""
    ap, dp, pp = p
    a, d = F.radians(lon) - F.lit(ap), F.radians(lat)
    theta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(d) * math.sin(dp) + F.cos(d) * math.cos(dp) * F.cos(a))))
    phi = F.lit(pp) + F.atan2(-F.cos(d) * F.sin(a), F.sin(d) * math.cos(dp) - F.cos(d) * math.sin(dp) * F.cos(a))
    return phi, theta


def pixel_to_world(p1: Column, p2: Column, w: Celestial) -> tuple[Column, Column]:
    """Longitude and latitude of a pixel."""
    x, y = linear(p1, p2, w)
    x, y = (y, x) if w.swapped else (x, y)
    return to_celestial(*deproject(x, y, w.projection), w.pole)


def world_to_pixel(lon: Column, lat: Column, w: Celestial) -> tuple[Column, Column]:
    """The pixel of a longitude and latitude."""
    x, y = project(*_wrapped(*to_native(lon, lat, w.pole), w.projection), w.projection)
    x, y = (y, x) if w.swapped else (x, y)
    n = w.inverse()
    return F.lit(float(w.crpix[0])) + F.lit(n[0][0]) * x + F.lit(n[0][1]) * y, F.lit(float(w.crpix[1])) + F.lit(n[1][0]) * x + F.lit(n[1][1]) * y


def _wrapped(phi: Column, theta: Column, projection: str) -> tuple[Column, Column]:
    """For CAR, the native longitude in (-180, 180] degrees."""
    if projection == "CAR":
        turns = F.floor((phi + F.lit(math.pi)) / F.lit(2 * math.pi))
        phi = phi - turns * F.lit(2 * math.pi)
    return phi, theta


#: Fixed values of the standard: spectral axis types and reference frames.
SPECTRAL = ("FREQ", "ENER", "WAVN", "VRAD", "WAVE", "VOPT", "ZOPT", "AWAV", "VELO", "BETA")
FRAMES = ("TOPOCENT", "GEOCENTR", "BARYCENT", "HELIOCEN", "LSRK", "LSRD", "GALACTOC", "LOCALGRP", "CMBDIPOL", "SOURCE")


def is_spectral(ctype: Column) -> Column:
    """Whether an axis type is spectral, by its first four letters."""
    return F.upper(F.substring(ctype, 1, 4)).isin(*SPECTRAL)


def frame(specsys: Column) -> Column:
    """The reference frame's name, or unknown."""
    name = F.upper(F.trim(specsys))
    return F.when(name.isin(*FRAMES), name).otherwise("unknown")


def spectral_value(pixel: Column, crval: float, cdelt: float, crpix: float = 1.0) -> Column:
    """crval + cdelt * (pixel - crpix)."""
    return F.lit(float(crval)) + F.lit(float(cdelt)) * (pixel - F.lit(float(crpix)))


def spectral_pixel(value: Column, crval: float, cdelt: float, crpix: float = 1.0) -> Column:
    """The pixel of a spectral value."""
    if cdelt == 0:
        raise NonInvertible("CDELT is zero")
    return F.lit(float(crpix)) + (value - F.lit(float(crval))) / F.lit(float(cdelt))
