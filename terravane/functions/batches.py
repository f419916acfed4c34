"""Whole Arrow batches of WKB at once: points, lines and polygons of one ring, little-endian and in two
dimensions. Other values are told apart, for a reader of single values."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

NAMES = np.array(["", "Point", "LineString", "Polygon"], object)
_HEAD = np.array([0, 5, 9, 13])  # bytes before the coordinates


def _at(raw: np.ndarray, kind: str) -> np.ndarray:
    """Numbers that begin at every byte."""
    wide = np.dtype(kind).itemsize
    return np.ndarray(max(0, len(raw) - wide + 1), np.dtype(kind), raw.data, strides=(1,))


class Batch:
    """plain: which values are such shapes; kind: 1, 2 or 3; size: points of each plain value; xy:
    their coordinates, one value after another; begin: where each one's begin there."""

    def __init__(self, values: pa.Array):
        n = len(values)
        self.length = n
        self.empty = np.ones(n, bool)
        self.plain = np.zeros(n, bool)
        self.kind = np.zeros(n, np.int64)
        self.size, self.begin, self.xy = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2))
        if not n:
            return
        wide = pa.types.is_large_binary(values.type)
        _, offsets, data = values.buffers()
        off = np.frombuffer(offsets, np.int64 if wide else np.int32)[values.offset : values.offset + n + 1].astype(np.int64)
        start, length = off[:-1], np.diff(off)
        valid = np.ones(n, bool) if not values.null_count else np.asarray(values.is_valid())
        length = np.where(valid, length, 0)
        self.empty = length == 0
        if data is None or self.empty.all():
            return
        raw = np.frombuffer(data, np.uint8)
        word = _at(raw, "<u4")
        rows = np.flatnonzero(length >= 21)
        kind = word[start[rows] + 1]
        rows, kind = rows[(raw[start[rows]] == 1) & (kind >= 1) & (kind <= 3)], kind[(raw[start[rows]] == 1) & (kind >= 1) & (kind <= 3)].astype(np.int64)
        points = np.where(kind == 1, 1, word[start[rows] + np.where(kind == 3, 9, 5)].astype(np.int64))
        fits = (length[rows] == _HEAD[kind] + 16 * points) & (points > 0) & ((kind != 3) | (word[start[rows] + 5] == 1))
        rows, kind, points = rows[fits], kind[fits], points[fits]
        begin = np.cumsum(points) - points
        place = np.repeat(start[rows] + _HEAD[kind], points) + 16 * (np.arange(int(points.sum())) - np.repeat(begin, points))
        number = _at(raw, "<f8")
        xy = np.stack([number[place], number[place + 8]], axis=1) if len(place) else np.zeros((0, 2))
        whole = np.ones(len(rows), bool)
        odd = np.flatnonzero(np.isnan(xy).any(axis=1))
        whole[np.searchsorted(begin, odd, "right") - 1] = False
        if len(odd):
            xy = xy[np.repeat(whole, points)]
            rows, kind, points = rows[whole], kind[whole], points[whole]
        self.plain[rows], self.kind[rows] = True, kind
        self.size, self.begin, self.xy = points, np.cumsum(points) - points, xy

    def boxes(self) -> np.ndarray:
        """(plain values, 4): xmin, ymin, xmax, ymax."""
        if not len(self.size):
            return np.zeros((0, 4))
        return np.concatenate([np.minimum.reduceat(self.xy, self.begin), np.maximum.reduceat(self.xy, self.begin)], axis=1)

    def turns(self) -> np.ndarray:
        """Of each plain value: 1 counterclockwise, -1 clockwise, 0 neither, 2 too close to tell here."""
        if not len(self.size):
            return np.zeros(0, np.int64)
        d = self.xy - np.repeat(self.xy[self.begin], self.size, axis=0)
        cross = np.zeros(len(d))
        cross[:-1] = d[:-1, 0] * d[1:, 1] - d[1:, 0] * d[:-1, 1]
        cross[self.begin[1:] - 1] = 0  # from one value's last point to the next one's first
        area, scale = np.add.reduceat(cross, self.begin), np.add.reduceat(np.abs(cross), self.begin)
        out = np.sign(area).astype(np.int64)
        out[(np.abs(area) <= 1e-9 * scale) & (scale > 0)] = 2
        out[self.size < 3] = 0
        return out

    def box_array(self, other: Callable[[int], tuple | None]) -> pa.StructArray:
        """Boxes as structs; `other` gives that of a value which isn't plain, by its place."""
        boxes, none = np.zeros((self.length, 4)), ~self.plain
        boxes[self.plain] = self.boxes()
        for i in np.flatnonzero(none & ~self.empty):
            if (box := other(int(i))) is not None:
                boxes[i], none[i] = box, False
        return pa.StructArray.from_arrays([pa.array(boxes[:, k].copy()) for k in range(4)], ["xmin", "ymin", "xmax", "ymax"], mask=pa.array(none))
