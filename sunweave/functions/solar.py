"""Time and solar-geometry expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_day_hour(day: Column, hour: Column) -> Column:
    """``YYYYDDD`` and ``H:M:S`` to a timestamp without time zone; anything else is NULL.

    The clock joins the date as text, so the session time zone plays no part. Each input is used
    once: the expression is evaluated in a filter too, and its size decides whether the JVM
    compiles the scan loop. The suffix makes an hour that does not match unreadable.
    """
    date = F.try_to_date(day.cast("string"), "yyyyDDD").cast("string")
    clock = F.regexp_extract(hour, r"^\d{1,2}:\d{1,2}:\d{1,2}$", 0)
    return F.concat(date, F.lit(" "), clock, F.lit(".0")).try_cast("timestamp_ntz")


def cyclic_time(ts: Column) -> dict[str, Column]:
    """Hour of day and day of year on the unit circle, and the month number."""
    hour = F.hour(ts) * F.lit(2 * math.pi) / 24.0
    doy = F.dayofyear(ts) * F.lit(2 * math.pi) / 365.0
    return {
        "hour_sin": F.sin(hour),
        "hour_cos": F.cos(hour),
        "doy_sin": F.sin(doy),
        "doy_cos": F.cos(doy),
        "month": F.month(ts),
    }


def clear_sky_irradiance(ts: Column, latitude: Column | float) -> Column:
    """0.75 x 1367 W/m2 x cos(zenith), zero at night."""
    lat = F.radians(latitude if isinstance(latitude, Column) else F.lit(float(latitude)))
    hour_angle = F.radians((F.hour(ts) + F.minute(ts) / 60.0 - 12.0) * 15.0)
    decl = F.radians(F.sin(F.radians((F.dayofyear(ts) + 284) * 360.0 / 365.0)) * 23.45)
    cos_zenith = F.sin(lat) * F.sin(decl) + F.cos(lat) * F.cos(decl) * F.cos(hour_angle)
    return F.greatest(cos_zenith, F.lit(0.0)) * 1367.0 * 0.75


def clearness_index(irradiance: Column, clear_sky: Column) -> Column:
    """Measured over clear-sky irradiance, clipped to [0, 1.5].

    The guard comes first: ``greatest``/``least`` skip NULL and would turn a missing ratio
    into 0 or 1.5 (T06).
    """
    ratio = irradiance / F.nullif(clear_sky, F.lit(0.0))
    return F.when(ratio.isNotNull(), F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.5)))


def season(ts: Column) -> Column:
    """Meteorological season of the northern hemisphere."""
    m = F.month(ts)
    return (
        F.when(m.isin(12, 1, 2), "Winter")
        .when(m.isin(3, 4, 5), "Spring")
        .when(m.isin(6, 7, 8), "Summer")
        .when(m.isin(9, 10, 11), "Autumn")
    )
