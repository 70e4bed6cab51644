"""Wind components, directions, codes and looped time, as column expressions.

Directions are degrees the wind blows from, north 0, clockwise; u is east, v north.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres per second of a knot; the range and steps of 10-bit wind codes.
MPS_PER_KNOT = 1852.0 / 3600.0
CODE_LOW, CODE_HIGH, CODE_STEPS = -60.0, 60.0, 1023


def turn(degrees: Column) -> Column:
    """Degrees in [0, 360)."""
    return F.pmod(degrees, F.lit(360.0))


def speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def from_direction(u: Column, v: Column) -> Column:
    """The direction a wind comes from."""
    return turn(270.0 - F.degrees(F.atan2(v, u)))


def components(speed: Column, direction: Column) -> tuple[Column, Column]:
    """(u, v) of a speed and from-direction; a speed that is not finite counts as calm."""
    theta = F.radians(270.0 - direction)
    fine = ~F.isnan(speed) & (F.abs(speed) < float("inf"))
    return F.when(fine, speed * F.cos(theta)).otherwise(F.lit(0.0)), F.when(fine, speed * F.sin(theta)).otherwise(F.lit(0.0))


def direction_or_north(u: Column, v: Column) -> Column:
    """from_direction(), and 0 for a calm."""
    return F.when((u == 0) & (v == 0), F.lit(0.0)).otherwise(from_direction(u, v))


def toward(speed: Column, direction: Column, factor: float = MPS_PER_KNOT) -> tuple[Column, Column]:
    """(u, v) in metres per second of the air's movement; factor converts the speed's unit."""
    s, b = speed * factor, F.radians(direction)
    return -s * F.sin(b), -s * F.cos(b)


def blend(a: Column, b: Column, f: Column) -> Column:
    """A direction a fraction of the way from a to b, by unit vectors."""
    y = F.sin(F.radians(a)) * (1 - f) + F.sin(F.radians(b)) * f
    x = F.cos(F.radians(a)) * (1 - f) + F.cos(F.radians(b)) * f
    return turn(F.degrees(F.atan2(y, x)))


def mean_direction(direction: Column, weight: Column | None = None) -> Column:
    """Aggregate: the weighted circular mean."""
    w = F.lit(1.0) if weight is None else weight
    return turn(F.degrees(F.atan2(F.sum(F.sin(F.radians(direction)) * w), F.sum(F.cos(F.radians(direction)) * w))))


def encode(value: Column) -> Column:
    """A component's 10-bit code, saturating."""
    scaled = F.round((value - CODE_LOW) / (CODE_HIGH - CODE_LOW) * CODE_STEPS)
    return F.least(F.greatest(scaled, F.lit(0.0)), F.lit(float(CODE_STEPS))).cast("int")


def decode(code: Column) -> Column:
    return code / CODE_STEPS * (CODE_HIGH - CODE_LOW) + CODE_LOW


def bracket(t: Column, frames: int, step: float, crossfade: float | None = None) -> tuple[Column, Column, Column]:
    """(lo, hi, alpha): the frames around a time and the weight of the second.

    Time loops after the last frame with a blend back to the first over ``crossfade`` seconds, by default
    five steps; one frame always stands for itself.
    """
    if frames <= 1:
        return F.lit(0), F.lit(0), F.lit(0.0)
    fade = 5 * step if crossfade is None else crossfade
    span = (frames - 1) * step
    inside = F.pmod(t, F.lit(span + fade)) if fade > 0 else F.pmod(t, F.lit(span))
    data = inside < span
    lo = F.least(F.floor(inside / step), F.lit(frames - 2)).cast("int")
    alpha = F.when(data, inside / step - lo).otherwise((inside - span) / (fade or 1.0))
    return F.when(data, lo).otherwise(F.lit(frames - 1)), F.when(data, lo + 1).otherwise(F.lit(0)), alpha


def frame_label(t: Column, frames: int, step: float) -> Column:
    """The frame shown at a time: the nearest, counted round without the blend."""
    return F.pmod(F.round(t / step), F.lit(float(frames))).cast("int")
