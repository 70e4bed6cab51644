"""Numbers as text, and the text codes of forecast archives, as column expressions.

Numbers are rounded by the exact value of the double, half to even, as most formatters do. Java's and Spark's own
rounding starts from the shortest decimal that reads as the double, which lies on a tie where the double does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, places: int) -> Column:
    """A double with 1 to 4 decimal places; nulls stay null, what has no fraction (from 2^53 on, infinite, no number) is
    left to Java."""
    size, scale = F.abs(value), 10**places
    whole = F.floor(size)
    part = size - whole
    high = F.floor(part * (1 << 26)) / (1 << 26)
    # high * scale and low * scale are exact, so the sign of the last sum is that of the distance from the tie
    above, low = high * scale, (part - high) * scale
    digits = F.floor(above)
    tie = (above - digits - 0.5) + low
    up = (tie > 0) | ((tie == 0) & (digits % 2 == 1))
    rounded = digits + up.cast("long")
    text = F.format_string(f"%s%d.%0{places}d", F.when(value < 0, "-").otherwise(""), whole + F.floor(rounded / scale), rounded % scale)
    return F.when(size < float(1 << 53), text).when(value.isNotNull(), F.format_string(f"%.{places}f", value))


def duration(seconds: Column) -> Column:
    """Whole seconds as ``1d 2h 3m 4s``, without leading zero parts."""
    s = F.floor(F.greatest(seconds, F.lit(0.0)))
    d, h, m, r = F.floor(s / 86400), F.floor((s % 86400) / 3600), F.floor((s % 3600) / 60), s % 60
    return (
        F.when(d > 0, F.format_string("%dd %dh %dm %ds", d, h, m, r))
        .when(h > 0, F.format_string("%dh %dm %ds", h, m, r))
        .when(m > 0, F.format_string("%dm %ds", m, r))
        .otherwise(F.format_string("%ds", r))
    )


def fuel(kg: Column) -> Column:
    return F.when(kg >= 1000, F.concat(fixed(kg / 1000, 3), F.lit(" t"))).otherwise(F.concat(fixed(kg, 2), F.lit(" kg")))


def land_km(metres: Column) -> Column:
    return F.concat(fixed(metres / 1000, 2), F.lit(" km"))


def magnitude(value: Column) -> Column:
    """A fitness without its sign, in thousands or millions."""
    size = F.abs(value)
    return F.when(size >= 1e6, F.concat(fixed(size / 1e6, 3), F.lit("M"))).otherwise(F.concat(fixed(size / 1e3, 3), F.lit("K")))


def against(found: Column, bench: Column, larger_is_better: bool) -> Column:
    """How a search result compares with its benchmark, in words."""
    diff = found - bench
    percent = F.abs(diff) / F.when(F.abs(bench) < 1e-12, F.lit(1.0)).otherwise(F.abs(bench)) * 100
    better = diff > 0 if larger_is_better else diff < 0
    return (
        F.when(F.abs(bench) < 1e-12, F.lit("PSO N/A"))
        .when(F.abs(diff) < 1e-9, F.lit("PSO equal"))
        .when(better, F.concat(F.lit("PSO "), fixed(percent, 1), F.lit("% better")))
        .otherwise(F.concat(F.lit("PSO "), fixed(percent, 1), F.lit("% worse")))
    )


def box_flag(lon_min: Column, lat_min: Column, lon_max: Column, lat_max: Column) -> Column:
    return F.concat(fixed(lon_min, 4), F.lit(","), fixed(lat_min, 4), F.lit(","), fixed(lon_max, 4), F.lit(","), fixed(lat_max, 4))


def forecast_seconds(unit: Column, value: Column) -> Column:
    """A forecast offset in seconds by its unit's code; null for units without a fixed length."""
    # Seconds of the unit codes.
    known = {0: 60, 1: 3600, 2: 86400, 10: 10800, 11: 21600, 12: 43200, 13: 1}
    out = F.lit(None).cast("long")
    for code, seconds in known.items():
        out = F.when(unit == code, value * seconds).otherwise(out)
    return out


def reference_seconds(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    """Unix seconds of a date and time in UTC; null for one that does not exist."""
    day = F.try_to_date(F.format_string("%04d-%02d-%02d", y, mo, d), "yyyy-MM-dd")
    fine = h.between(0, 23) & mi.between(0, 59) & s.between(0, 59)
    return F.when(fine, F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + h * 3600 + mi * 60 + s)


def day_hour(text: Column) -> Column:
    """(seconds, error) of ``YYYYMMDD`` or ``YYYYMMDDHH``: error names what is wrong, else it is null."""
    number = text.rlike("^[0-9]+$")
    size = F.length(text).isin(8, 10)
    hour = F.coalesce(F.try_to_number(F.nullif(F.substring(text, 9, 2), F.lit("")), F.lit("99")).cast("int"), F.lit(0))
    day = F.when(number & size, F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd"))
    error = F.when(~size, F.lit("length")).when(~number, F.lit("digits")).when(day.isNull(), F.lit("date")).when(hour > 23, F.lit("hour"))
    seconds = F.when(error.isNull(), F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + hour * 3600)
    return F.struct(seconds.alias("seconds"), error.alias("error"))


def cycle(hour: Column) -> tuple[Column, Column]:
    """(cycle, forecast hour) of an hour of the day: six-hourly cycles, at most five hours ahead."""
    start = (F.floor(hour / 6) * 6).cast("int")
    return start, (hour - start).cast("int")
