"""Grid squares, distances, addresses and callsign prefixes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
# Fixed value: prefixes of other countries.
FOREIGN = "^(V[AEOY]|C[FGIJKYZ]|X[EFJ]|[GM]|2[EMW]|E[IJ]|Z[LS]|JA|VK)"


def _letter(grid: Column, at: int) -> Column:
    return F.ascii(F.substring(F.upper(grid), at, 1)) - 65


def _digit(grid: Column, at: int) -> Column:
    return F.ascii(F.substring(grid, at, 1)) - 48


def _fine(grid: Column) -> Column:
    return F.upper(grid).rlike("^[A-Z]{2}[0-9]{2}[A-Z]{2}")


def grid_longitude(grid: Column) -> Column:
    """Centre of a square of four or six characters in degrees; null if it is none."""
    base = _letter(grid, 1) * 20.0 - 180 + _digit(grid, 3) * 2.0
    return F.when(_fine(grid), base + _letter(grid, 5) * (2.0 / 24) + 1.0 / 24).when(F.upper(grid).rlike("^[A-Z]{2}[0-9]{2}"), base + 1.0)


def grid_latitude(grid: Column) -> Column:
    base = _letter(grid, 2) * 10.0 - 90 + _digit(grid, 4) * 1.0
    return F.when(_fine(grid), base + _letter(grid, 6) * (1.0 / 24) + 0.5 / 24).when(F.upper(grid).rlike("^[A-Z]{2}[0-9]{2}"), base + 0.5)


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def address_state(line: Column) -> Column:
    """The two-letter state at the end of an address line, before a ZIP code if there is one."""
    return F.nullif(F.regexp_extract(line, r"\b([A-Z]{2})(?:\s+[0-9]{5}(?:-[0-9]{4})?)?\s*$", 1), F.lit(""))


def is_non_us(callsign: Column) -> Column:
    """Callsigns of other countries, which a United States register cannot answer for."""
    return callsign.rlike(FOREIGN)
