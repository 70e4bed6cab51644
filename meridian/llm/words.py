"""Words and byte n-grams of many texts at once, as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)
MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD2
    return (x ^ (x >> np.uint64(29))) * ODD


class Words:
    """Word starts, ends and hashes of lines of single-spaced words."""

    def __init__(self, lines: list[bytes]):
        self.buf = b"\n".join(lines)
        raw = np.frombuffer(self.buf + b"\n" + b"\0" * 8, np.uint8)
        a = raw[: len(self.buf) + 1]
        stops = np.flatnonzero((a == 32) | (a == 10))
        starts = np.concatenate([[0], stops[:-1] + 1])
        line_ends = np.flatnonzero(a[stops] == 10)
        full = stops > starts  # an empty line has no word
        self.starts, self.ends = starts[full], stops[full]
        upto = np.cumsum(full)[line_ends]
        self.first = np.concatenate([[0], upto[:-1]])  # of each line
        self.count = upto - self.first
        size = self.ends - self.starts
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        short = np.minimum(size, 8)
        head = eight[self.starts] & MASKS[short]
        tail = eight[self.ends - short] & MASKS[short]
        self.hash = mix(head + mix(tail + size.astype(np.uint64) * ODD))

    def runs(self, m: int) -> np.ndarray:
        """Hash of the m words from each word on; meaningless near a line's end."""
        h = self.hash
        n = max(0, len(h) - m + 1)
        out = np.zeros(len(h), np.uint64)
        mixed = h[:n].copy()
        for k in range(1, m):
            mixed = mix(mixed) + h[k : n + k]
        out[:n] = mix(mixed)
        return out

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows, and their lines."""
        n = np.maximum(self.count - width + 1, 0)
        line = np.repeat(np.arange(len(n)), n)
        return self.first[line] + np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n), line


def normal(text: bytes) -> bytes:
    """The text's words joined by single spaces."""
    return b" ".join(text.split())


def packs(rows: Iterator[tuple], most: int, length=lambda row: len(row[0])) -> Iterator[list[tuple]]:
    """Rows in lists of about ``most`` bytes; a row longer than that is a list of its own."""
    held, size = [], 0
    for row in rows:
        n = length(row)
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield held
