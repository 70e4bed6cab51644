"""GRIB2 messages on regular latitude-longitude grids.

A file is read by one task, message by message: headers first, so that only messages of
the 10 m wind are unpacked, and of those only the rows and columns that a box and a stride
leave become rows. Values may be packed simply (5.0), in groups with or without spatial
differences (5.2, 5.3), as IEEE numbers (5.4) or as an image (5.41). A message that cannot
be unpacked is passed over with a warning. Numbers are big-endian; signed ones have a sign
bit.
"""

from __future__ import annotations

import datetime as dt
import logging
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions import winds
from meridian.functions.geo import Box

# Seconds of the time unit codes.
UNITS = {0: 60, 1: 3600, 2: 86400, 10: 10800, 11: 21600, 12: 43200, 13: 1}


def _signed(raw: bytes) -> int:
    n = int.from_bytes(raw, "big")
    top = 1 << (8 * len(raw) - 1)
    return -(n - top) if n & top else n


@dataclass
class Message:
    number: int
    discipline: int
    category: int
    parameter: int
    surface: int
    height: float
    reference: int | None
    ahead: int | None
    nx: int
    ny: int
    lat1: float
    lon1: float
    dlat: float
    dlon: float
    scan: int
    template: int
    packing: bytes
    data: bytes
    bitmap: bytes | None

    @property
    def valid(self) -> int | None:
        return None if self.reference is None or self.ahead is None else self.reference + self.ahead

    @property
    def ten_metre_wind(self) -> bool:
        return self.discipline == 0 and self.category == 2 and self.parameter in (2, 3) and self.surface == 103 and abs(self.height - 10) <= 0.5

    @property
    def axes(self) -> tuple[np.ndarray, np.ndarray]:
        """Latitudes of the rows and longitudes of the columns, in the order of values()."""
        return np.round(self.lat1 + np.arange(self.ny) * self.dlat, 6), np.round(self.lon1 + np.arange(self.nx) * self.dlon, 6)

    def values(self) -> np.ndarray:
        """[row, column], NaN where there is none; ValueError for what cannot be unpacked."""
        if self.template not in UNPACKERS:
            raise ValueError(f"data template 5.{self.template} is not supported")
        points = self.nx * self.ny
        have = np.unpackbits(np.frombuffer(self.bitmap, np.uint8))[:points].astype(bool) if self.bitmap is not None else np.ones(points, bool)
        out = np.full(points, np.nan)
        found = UNPACKERS[self.template](self.packing, self.data, int(have.sum()))
        if len(found) != have.sum():
            raise ValueError(f"{len(found)} values for {have.sum()} points")
        out[have] = found
        # consecutive points run along columns, and every second run may go backwards
        grid = out.reshape(self.nx, self.ny) if self.scan & 0x20 else out.reshape(self.ny, self.nx)
        if self.scan & 0x10:
            grid[1::2] = grid[1::2, ::-1].copy()
        return grid.T if self.scan & 0x20 else grid


def bits_of(raw: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8))


def numbers(bits: np.ndarray, widths: np.ndarray, at: int = 0) -> np.ndarray:
    """Unsigned numbers of some widths, one after the other from a bit on."""
    widths = np.asarray(widths, np.int64)
    start = at + np.cumsum(widths) - widths
    if len(widths) and start[-1] + widths[-1] > len(bits):
        raise ValueError("the data ends early")
    out = np.zeros(len(widths), np.int64)
    for k in range(int(widths.max(initial=0))):
        on = widths > k
        out[on] = out[on] << 1 | bits[start[on] + k]
    return out


def _scales(rep: bytes) -> tuple[float, float, float]:
    return struct.unpack(">f", rep[11:15])[0], 2.0 ** _signed(rep[15:17]), 10.0 ** _signed(rep[17:19])


def simple(rep: bytes, data: bytes, n: int) -> np.ndarray:
    base, binary, decimal = _scales(rep)
    codes = numbers(bits_of(data), np.full(n, rep[19])) if rep[19] else np.zeros(n, np.int64)
    return (base + codes * binary) / decimal


def grouped(rep: bytes, data: bytes, n: int) -> np.ndarray:
    """Groups of numbers with a reference and a width each; with template 5.3 they are spatial differences."""
    base, binary, decimal = _scales(rep)
    ref_bits, missing = rep[19], rep[22]
    groups, least_width, width_bits = int.from_bytes(rep[31:35], "big"), rep[35], rep[36]
    least_length, step, last_length, length_bits = int.from_bytes(rep[37:41], "big"), rep[41], int.from_bytes(rep[42:46], "big"), rep[46]
    order, size = (rep[47], rep[48]) if int.from_bytes(rep[9:11], "big") == 3 else (0, 0)
    began = [_signed(data[k * size : (k + 1) * size]) for k in range(order + 1)] if order else []
    bits, at = bits_of(data), 8 * size * len(began)

    def listed(width: int) -> np.ndarray:
        nonlocal at
        out = numbers(bits, np.full(groups, width), at)
        at = -(-(at + groups * width) // 8) * 8  # lists end with whole octets
        return out

    refs, widths, lengths = listed(ref_bits), least_width + listed(width_bits), least_length + step * listed(length_bits)
    if groups:
        lengths[-1] = last_length
    if lengths.sum() != n:
        raise ValueError(f"{lengths.sum()} values in groups for {n} points")
    wide = np.repeat(widths, lengths)
    inside, ref = numbers(bits, wide, at), np.repeat(refs, lengths)
    codes, gone = ref + inside, np.zeros(n, bool)
    for k in range(1, missing + 1):  # the largest numbers of a group stand for missing values
        gone |= np.where(wide > 0, inside == (1 << wide) - k, ref == (1 << ref_bits) - k)
    x = codes[~gone]
    if order and len(x):
        x[order:] += began[-1]
        x[:order] = began[: min(order, len(x))]
        if order == 2 and len(x) > 1:
            x[1] -= x[0]
            x[1:] = np.cumsum(x[1:])
        x = np.cumsum(x)
    out = np.full(n, np.nan)
    out[~gone] = (base + x * binary) / decimal
    return out


def ieee(rep: bytes, data: bytes, n: int) -> np.ndarray:
    kind = {1: ">f4", 2: ">f8"}.get(rep[11])
    if kind is None:
        raise ValueError("numbers of this precision are not supported")
    return np.frombuffer(data, kind).astype(float)


def pixels(raw: bytes) -> tuple[np.ndarray, int]:
    """The samples of a PNG image without interlacing, as bits row by row, and the bits of a pixel."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not an image")
    at, packed, head = 8, [], b""
    while at + 8 <= len(raw):
        size, kind = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
        if kind == b"IHDR":
            head = raw[at + 8 : at + 8 + size]
        elif kind == b"IDAT":
            packed.append(raw[at + 8 : at + 8 + size])
        at += size + 12
    wide, high, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    if interlaced or colour not in (0, 2, 6):
        raise ValueError("an image of a kind that is not supported")
    pixel = depth * {0: 1, 2: 3, 6: 4}[colour]
    line, step = -(-wide * pixel // 8), max(1, pixel // 8)
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(high, line + 1)
    out, above = np.zeros((high, line), np.uint8), np.zeros(line, np.uint8)
    for y in range(high):
        kind, row = rows[y, 0], rows[y, 1:]
        if kind == 1:  # differences from the pixel to the left
            padded = np.zeros(-(-line // step) * step, np.uint8)
            padded[:line] = row
            row = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:line]
        elif kind == 2:
            row = row + above
        elif kind in (3, 4):
            was, now = above.tolist(), [0] * line
            for i, v in enumerate(row.tolist()):
                left, up, corner = (now[i - step], was[i], was[i - step]) if i >= step else (0, was[i], 0)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    far = [abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)]
                    guess = (left, up, corner)[far.index(min(far))]
                now[i] = (v + guess) & 255
            row = np.array(now, np.uint8)
        out[y] = above = row
    return np.unpackbits(out, axis=1)[:, : wide * pixel].ravel(), pixel


def image(rep: bytes, data: bytes, n: int) -> np.ndarray:
    base, binary, decimal = _scales(rep)
    if not rep[19]:
        return np.full(n, base / decimal)
    bits, pixel = pixels(data)
    return (base + numbers(bits, np.full(len(bits) // pixel, pixel)) * binary) / decimal


UNPACKERS = {0: simple, 2: grouped, 3: grouped, 4: ieee, 41: image}


def messages(raw: bytes) -> Iterator[Message]:
    """The messages of a file; grids other than regular latitude-longitude ones are passed over."""
    at, number = 0, 0
    while (at := raw.find(b"GRIB", at)) >= 0:
        discipline, length = raw[at + 6], int.from_bytes(raw[at + 8 : at + 16], "big")
        end, p = at + length, at + 16
        s: dict[int, bytes] = {}
        bitmap = None
        while p + 5 <= min(end, len(raw)) and raw[p : p + 4] != b"7777":
            size = int.from_bytes(raw[p : p + 4], "big")
            if size < 5:
                break
            part, s[part] = raw[p + 4], raw[p : p + size]
            p += size
            if part == 6 and s[6][5] != 254:  # 254: the bit map of the message before
                bitmap = s[6][6:] if s[6][5] == 0 else None
            if part == 7:
                number += 1
                if (m := _message(number, discipline, s, bitmap)) is not None:
                    yield m
        at = max(end, at + 4)


def _message(number: int, discipline: int, s: dict[int, bytes], bitmap: bytes | None) -> Message | None:
    if not {1, 3, 4, 5, 7} <= set(s) or struct.unpack(">H", s[3][12:14])[0] != 0:
        return None
    ids, grid, product, rep = s[1], s[3], s[4], s[5]
    try:
        reference = int(dt.datetime(struct.unpack(">H", ids[12:14])[0], *ids[14:19], tzinfo=dt.UTC).timestamp())
    except ValueError:
        reference = None
    unit, ahead = product[17], int.from_bytes(product[18:22], "big")
    height = _signed(product[24:28]) / 10.0 ** _signed(product[23:24])
    nx, ny = (int.from_bytes(grid[k : k + 4], "big") for k in (30, 34))
    lat1, lon1 = _signed(grid[46:50]) / 1e6, _signed(grid[50:54]) / 1e6
    dlon, dlat = (int.from_bytes(grid[k : k + 4], "big") / 1e6 for k in (63, 67))
    scan = grid[71]
    return Message(
        number, discipline, product[9], product[10], product[22], height, reference, ahead * UNITS[unit] if unit in UNITS else None,
        nx, ny, lat1, lon1, dlat if scan & 0x40 else -dlat, -dlon if scan & 0x80 else dlon, scan, struct.unpack(">H", rep[9:11])[0], rep, s[7][5:], bitmap,
    )


def _sign(v: int, n: int) -> bytes:
    return (abs(v) | ((1 << (8 * n - 1)) if v < 0 else 0)).to_bytes(n, "big")


def _packed(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Numbers of some widths as whole octets."""
    widths = np.asarray(widths, np.int64)
    start = np.cumsum(widths) - widths
    bits = np.zeros(int(widths.sum()), np.uint8)
    for k in range(int(widths.max(initial=0))):
        on = widths > k
        bits[start[on] + k] = codes[on] >> (widths[on] - 1 - k) & 1
    return np.packbits(bits).tobytes()


def _grouped(codes: np.ndarray, order: int, group: int) -> tuple[bytes, bytes]:
    """(template part after the scales, data) of numbers in groups of a size, as differences of an order."""
    lead = b""
    if order:
        d = np.diff(codes, order)
        least = int(d.min(initial=0))
        lead = b"".join(_sign(int(v), 5) for v in [*codes[:order], least])
        codes = np.concatenate([np.zeros(min(order, len(codes)), np.int64), d - least])
    parts = [codes[k : k + group] for k in range(0, len(codes), group)] or [codes]
    refs = np.array([p.min(initial=1 << 62) if len(p) else 0 for p in parts], np.int64)
    widths = np.array([int(p.max() - r).bit_length() if len(p) else 0 for p, r in zip(parts, refs, strict=True)], np.int64)
    ref_bits, width_bits = int(refs.max()).bit_length(), int(widths.max()).bit_length()
    n = len(parts)
    u = lambda v, k: int(v).to_bytes(k, "big")
    head = bytes([ref_bits, 0, 1, 0]) + bytes(8) + u(n, 4) + bytes([0, width_bits]) + u(group, 4) + bytes([1]) + u(len(parts[-1]), 4) + bytes([0])
    head += bytes([order, 5]) if order else b""
    inside = _packed(codes - np.repeat(refs, [len(p) for p in parts]), np.repeat(widths, [len(p) for p in parts]))
    return head, lead + _packed(refs, np.full(n, ref_bits)) + _packed(widths, np.full(n, width_bits)) + inside


def _image(codes: np.ndarray, nx: int, kind: int) -> bytes:
    """Numbers of 16 bits as an image, its rows as differences of a kind."""
    rows = codes.astype(">u2").view(np.uint8).reshape(-1, 2 * nx).astype(np.int64)
    left = np.pad(rows, ((0, 0), (2, 0)))[:, :-2]
    up = np.pad(rows, ((1, 0), (0, 0)))[:-1]
    corner = np.pad(left, ((1, 0), (0, 0)))[:-1]
    far = np.stack([abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)])
    guess = [0, left, up, (left + up) // 2, np.choose(far.argmin(axis=0), [left, up, corner])][kind]
    lines = np.concatenate([np.full((len(rows), 1), kind), (rows - guess) % 256], axis=1).astype(np.uint8).tobytes()
    chunk = lambda name, body: len(body).to_bytes(4, "big") + name + body + zlib.crc32(name + body).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", nx, len(rows), 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def write_message(lat: np.ndarray, lon: np.ndarray, values: np.ndarray, parameter: int, reference: dt.datetime, ahead_h: int, bits: int = 16, height: int = 10, template: int = 0, order: int = 1, scan: int = 0x40, group: int = 32) -> bytes:
    """A message of the wind at a height on a grid of ascending axes, for tests and small archives.

    template: how values are packed; order: of the differences of template 5.3, or the filter of the image of 5.41;
    scan: its bits 0x20 and 0x10 set the order of the points.
    """
    grid = np.asarray(values, float)
    grid = grid.T.copy() if scan & 0x20 else grid.copy()
    if scan & 0x10:
        grid[1::2] = grid[1::2, ::-1].copy()
    flat = grid.ravel()
    fine = np.isfinite(flat)
    low, high = (float(flat[fine].min()), float(flat[fine].max())) if fine.any() else (0.0, 0.0)
    near = np.float32(low)
    low = float(near if near <= low else np.nextafter(near, np.float32(-np.inf)))
    binary = 0
    while (high - low) / 2.0**binary > (1 << bits) - 1:
        binary += 1
    while binary > -30 and (high - low) / 2.0 ** (binary - 1) <= (1 << bits) - 1:
        binary -= 1
    codes = np.rint((flat[fine] - low) / 2.0**binary).astype(np.int64)
    u = lambda v, n: int(v).to_bytes(n, "big")
    r = reference
    ids = u(7, 2) + u(0, 2) + bytes([2, 1, 1]) + u(r.year, 2) + bytes([r.month, r.day, r.hour, r.minute, r.second, 0, 1])
    nx, ny = len(lon), len(lat)
    micro = lambda v: _sign(round(float(v) * 1e6), 4)
    shape = bytes([0]) + u(nx * ny, 4) + bytes([0, 0]) + u(0, 2) + bytes([6]) + bytes(15) + u(nx, 4) + u(ny, 4) + bytes(8) + micro(lat[0]) + micro(lon[0]) + bytes([48]) + micro(lat[-1]) + micro(lon[-1]) + u(round((lon[1] - lon[0]) * 1e6), 4) + u(round((lat[1] - lat[0]) * 1e6), 4) + bytes([scan])
    product = u(0, 2) + u(0, 2) + bytes([2, parameter, 2, 0, 0]) + u(0, 2) + bytes([0, 1]) + u(ahead_h, 4) + bytes([103, 0]) + u(height, 4) + bytes([255, 0]) + bytes(4)
    scales = struct.pack(">f", low) + _sign(binary, 2) + u(0, 2)
    if template in (2, 3):
        more, data = _grouped(codes, order if template == 3 else 0, group)
    elif template == 4:
        scales, more, data = b"", bytes([2]), flat[fine].astype(">f8").tobytes()
    elif template == 41:
        more, data = bytes([16, 0]), _image(codes, grid.shape[1], order)
    else:
        more, data = bytes([bits, 0]), _packed(codes, np.full(len(codes), bits))
    rep = u(len(codes), 4) + u(template, 2) + scales + more
    whole = bytes([255]) if fine.all() else bytes([0]) + np.packbits(fine).tobytes()
    body = b"".join(u(len(part) + 5, 4) + bytes([n]) + part for n, part in ((1, ids), (3, shape), (4, product), (5, rep), (6, whole), (7, data)))
    return b"GRIB" + bytes(2) + bytes([0, 2]) + u(len(body) + 20, 8) + body + b"7777"


def _kept(axis: np.ndarray, low: float | None, high: float | None, step: int) -> np.ndarray:
    """Places on an axis within bounds, every step-th of its values in ascending order."""
    inside = np.arange(len(axis)) if low is None else np.flatnonzero((axis >= low) & (axis <= high))
    return np.sort(inside[np.argsort(axis[inside], kind="stable")][::step])


def unpacked(files: DataFrame, step: int = 1, box: Box | None = None) -> DataFrame:
    """(t, file, msg, is_u, lat, lon, value) of the 10 m wind in files (path, content); one task a file, a message at a
    time. Box and stride are applied to a message's axes before its points become rows."""

    def run(batches):
        for some in batches:
            for path, content in zip(some["path"], some["content"], strict=True):
                for m in messages(content):
                    if not m.ten_metre_wind or m.valid is None:
                        continue
                    lat, lon = m.axes
                    j, i = _kept(lat, *((box.lat_min, box.lat_max) if box else (None, None)), step), _kept(lon, *((box.lon_min, box.lon_max) if box else (None, None)), step)
                    if not len(i) or not len(j):
                        continue
                    try:
                        value = m.values()[np.ix_(j, i)]
                    except (ValueError, IndexError, struct.error, zlib.error) as e:
                        logging.getLogger(__name__).warning("message %d of %s is passed over: %s", m.number, path, e)
                        continue
                    yield pd.DataFrame({"t": m.valid, "file": path, "msg": m.number, "is_u": m.parameter == 2, "lat": np.repeat(lat[j], len(i)), "lon": np.tile(lon[i], len(j)), "value": value.ravel()})

    return files.select("path", "content").mapInPandas(run, "t long, file string, msg int, is_u boolean, lat double, lon double, value double")


def read_messages(spark: SparkSession, path: str, step: int = 1, box: Box | None = None) -> DataFrame:
    """unpacked() of all files at a path."""
    return unpacked(spark.read.format("binaryFile").load(path), step, box)


def winds_of(rows: DataFrame) -> DataFrame:
    """unpacked() rows as (t_seconds, lon, lat, speed, direction): of several messages for a time the last of the last file
    counts; points without both components or with one that is not finite are left out; speeds are as stored."""
    order = F.struct("file", "msg")
    last = lambda kind: F.max_by(F.when(kind, F.struct("value")), F.when(kind, order))["value"]
    both = rows.groupBy("t", "lat", "lon").agg(last(F.col("is_u")).alias("u"), last(~F.col("is_u")).alias("v"))
    both = both.filter("u is not null and v is not null and not isnan(u) and not isnan(v)")
    return both.select(F.col("t").alias("t_seconds"), "lon", "lat", winds.speed(F.col("u"), F.col("v")).alias("speed"), winds.from_direction(F.col("u"), F.col("v")).alias("direction"))


def load(spark: SparkSession, path: str, step: int = 1, box: Box | None = None) -> DataFrame:
    """winds_of() the files at a path, cut to a box, then thinned to every step-th value of each message's axes."""
    return winds_of(read_messages(spark, path, step, box))
