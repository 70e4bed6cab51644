"""Spherical geometry on arrays, as meridian.functions.geo has it on columns."""

from __future__ import annotations

import numpy as np

from meridian.functions.geo import LEAST_COS, METRES_PER_DEGREE, POLE_LAT, RADIUS_M


def wrap_lon(lon):
    turned = np.mod(np.asarray(lon, float) + 540.0, 360.0) - 180.0
    return np.where(turned == -180.0, 180.0, turned)


def lon_delta(a, b):
    return wrap_lon(np.asarray(b, float) - a)


def haversine(x1, y1, x2, y2):
    up, across = np.sin(np.radians(y2 - y1) / 2), np.sin(np.radians(x2 - x1) / 2)
    h = up * up + np.cos(np.radians(y1)) * np.cos(np.radians(y2)) * across * across
    return 2 * RADIUS_M * np.arcsin(np.sqrt(np.clip(h, 0.0, 1.0)))


def bearing(x1, y1, x2, y2):
    """Radians; NaN at a pole."""
    d, a, b = np.radians(x2 - x1), np.radians(y1), np.radians(y2)
    angle = np.arctan2(np.sin(d) * np.cos(b), np.cos(a) * np.sin(b) - np.sin(a) * np.cos(b) * np.cos(d))
    return np.where(np.abs(y1) < POLE_LAT, angle, np.nan)


def destination(x, y, metres, angle):
    """NaN from a pole."""
    c, a = metres / RADIUS_M, np.radians(y)
    b = np.arcsin(np.clip(np.sin(a) * np.cos(c) + np.cos(a) * np.sin(c) * np.cos(angle), -1.0, 1.0))
    d = np.arctan2(np.sin(angle) * np.sin(c) * np.cos(a), np.cos(c) - np.sin(a) * np.sin(b))
    fine = np.abs(y) < POLE_LAT
    return np.where(fine, wrap_lon(x + np.degrees(d)), np.nan), np.where(fine, np.degrees(b), np.nan)


def to_tangent(y, dlon, dlat):
    return dlon * METRES_PER_DEGREE * np.cos(np.radians(y)), dlat * METRES_PER_DEGREE


def offset(x, y, east, north):
    """Moved by tangent metres, kept off the poles."""
    dlon = east / (np.maximum(np.cos(np.radians(y)), LEAST_COS) * METRES_PER_DEGREE)
    return wrap_lon(x + dlon), np.clip(y + north / METRES_PER_DEGREE, -POLE_LAT, POLE_LAT)


def clamp(box, x, y):
    """Into a meridian.functions.geo.Box."""
    if box.wraps:
        inside = (x >= box.lon_min) | (x <= box.lon_max)
        near = np.abs(lon_delta(x, box.lon_min)) <= np.abs(lon_delta(x, box.lon_max))
        x = np.where(inside, x, np.where(near, box.lon_min, box.lon_max))
    else:
        x = np.clip(x, box.lon_min, box.lon_max)
    return x, np.clip(y, max(box.lat_min, -POLE_LAT), min(box.lat_max, POLE_LAT))
