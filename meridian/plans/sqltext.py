"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

R = "6371000.0::DOUBLE"
MPD = "(pi() * 6371000.0::DOUBLE / 180)"


def mod(x, m) -> str:
    return f"(({x}) - {m} * floor(({x}) / {m}))"


def wrap(x) -> str:
    turned = f"({mod(f'({x}) + 540.0::DOUBLE', '360.0::DOUBLE')} - 180)"
    return f"(CASE WHEN {turned} = -180 THEN 180.0::DOUBLE ELSE {turned} END)"


def delta(a, b) -> str:
    return wrap(f"({b}) - ({a})")


def hav(x1, y1, x2, y2) -> str:
    up, across = f"sin(radians(({y2}) - ({y1})) / 2)", f"sin(radians(({x2}) - ({x1})) / 2)"
    return f"(2 * {R} * asin(sqrt(least(greatest({up} * {up} + cos(radians({y1})) * cos(radians({y2})) * {across} * {across}, 0.0::DOUBLE), 1.0::DOUBLE))))"


def brg(x1, y1, x2, y2) -> str:
    d, a, b = f"radians(({x2}) - ({x1}))", f"radians({y1})", f"radians({y2})"
    return f"(CASE WHEN abs({y1}) < 89.99 THEN atan2(sin({d}) * cos({b}), cos({a}) * sin({b}) - sin({a}) * cos({b}) * cos({d})) END)"


def dest(x, y, m, angle) -> tuple[str, str]:
    c, a = f"(({m}) / {R})", f"radians({y})"
    b = f"asin(least(greatest(sin({a}) * cos({c}) + cos({a}) * sin({c}) * cos({angle}), -1.0::DOUBLE), 1.0::DOUBLE))"
    d = f"atan2(sin({angle}) * sin({c}) * cos({a}), cos({c}) - sin({a}) * sin({b}))"
    return wrap(f"({x}) + degrees({d})"), f"degrees({b})"


def tangent(y, dx, dy) -> tuple[str, str]:
    return f"(({dx}) * {MPD} * cos(radians({y})))", f"(({dy}) * {MPD})"


def rnd(x, n) -> str:
    """Rounded, without a negative zero."""
    return f"(round({x}, {n}) + 0.0::DOUBLE)"


def circ(s, c) -> str:
    return mod(f"degrees(atan2({s}, {c}))", "360.0::DOUBLE")
