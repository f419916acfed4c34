"""Geometries as GeoJSON-like dicts; WKB, WKT and GeoJSON codecs. Coordinates are two-dimensional:
further ordinates are read and dropped."""

from __future__ import annotations

import json
import math
import re
import struct

import numpy as np

from ..errors import GeometryError

NAMES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
CODES = {v: k for k, v in NAMES.items()}
_PARTS = {"MultiPoint": "Point", "MultiLineString": "LineString", "MultiPolygon": "Polygon"}


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        size = struct.calcsize(form)
        if self.at + size > len(self.data):
            raise GeometryError("unexpected end of WKB")
        out = struct.unpack_from(form, self.data, self.at)
        self.at += size
        return out

    def header(self) -> tuple[str, str, int]:
        (order,) = self.take("B")
        if order > 1:
            raise GeometryError(f"invalid WKB byte order {order}")
        end = "<" if order else ">"
        (code,) = self.take(end + "I")
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        if code & 0x20000000:
            self.take(end + "I")
        code &= 0x0FFFFFFF
        if code >= 1000:
            dims += {1: 1, 2: 1, 3: 2}.get(code // 1000, 0)
            code %= 1000
        if code not in NAMES:
            raise GeometryError(f"unknown WKB geometry type {code}")
        return end, NAMES[code], dims

    def points(self, end: str, n: int, dims: int) -> np.ndarray:
        size = 8 * n * dims
        if n < 0 or self.at + size > len(self.data):
            raise GeometryError("unexpected end of WKB")
        out = np.frombuffer(self.data, end + "f8", n * dims, self.at).reshape(n, dims)[:, :2]
        self.at += size
        return out

    def arrays(self, depth: int = 0):
        """(name, parts): parts are arrays of points, or geometries."""
        if depth > 32:
            raise GeometryError("geometries are nested too deep")
        end, name, dims = self.header()
        if name == "Point":
            return name, self.points(end, 1, dims)
        (n,) = self.take(end + "I")
        if name == "LineString":
            return name, self.points(end, n, dims)
        if n > len(self.data):
            raise GeometryError("unexpected end of WKB")
        if name == "Polygon":
            return name, [self.points(end, self.take(end + "I")[0], dims) for _ in range(n)]
        parts = []
        for _ in range(n):
            part = self.arrays(depth + 1)
            if name in _PARTS and part[0] != _PARTS[name]:
                raise GeometryError(f"unexpected {part[0]} in a {name}")
            parts.append(part)
        return name, parts


def parse_wkb(data: bytes):
    """(name, parts) of WKB or EWKB in either byte order."""
    return _Reader(bytes(data)).arrays()


def _flat(geometry) -> list[np.ndarray]:
    name, parts = geometry
    if name in ("Point", "LineString"):
        return [parts]
    if name == "Polygon":
        return list(parts)
    return [a for p in parts for a in _flat(p)]


def _json(geometry) -> dict:
    name, parts = geometry
    if name == "Point":
        return {"type": name, "coordinates": parts[0].tolist()}
    if name == "LineString":
        return {"type": name, "coordinates": parts.tolist()}
    if name == "Polygon":
        return {"type": name, "coordinates": [r.tolist() for r in parts]}
    if name == "GeometryCollection":
        return {"type": name, "geometries": [_json(p) for p in parts]}
    return {"type": name, "coordinates": [_json(p)["coordinates"] for p in parts]}


def from_wkb(data: bytes) -> dict:
    return _json(parse_wkb(data))


def _points(values, least: int = 2) -> list[list[float]]:
    if not isinstance(values, list):
        raise GeometryError("coordinates must be lists of positions")
    return [_position(v) for v in values]


def _position(v) -> list[float]:
    if not isinstance(v, list) or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v):
        raise GeometryError(f"invalid position {json.dumps(v)}")
    if not v:
        return [0.0, 0.0]  # an empty position reads as the origin
    if len(v) < 2:
        raise GeometryError(f"invalid position {json.dumps(v)}")
    return [float(v[0]), float(v[1])]


def from_geojson(value: dict) -> dict:
    """Checks a GeoJSON geometry object and drops further ordinates and members."""
    if not isinstance(value, dict) or not isinstance(value.get("type"), str):
        raise GeometryError("geometry must be an object with a type")
    name = value["type"]
    if name not in CODES:
        raise GeometryError(f"invalid geometry type {json.dumps(name)}")
    if name == "GeometryCollection":
        members = value.get("geometries")
        return {"type": name, "geometries": [from_geojson(g) for g in members or []]}
    c = value.get("coordinates")
    if c is None:
        raise GeometryError("geometry must have coordinates")
    try:
        if name == "Point":
            return {"type": name, "coordinates": _position(c)}
        if name in ("LineString", "MultiPoint"):
            return {"type": name, "coordinates": _points(c)}
        if name in ("Polygon", "MultiLineString"):
            return {"type": name, "coordinates": [_points(r) for r in c]}
        return {"type": name, "coordinates": [[_points(r) for r in p] for p in c]}
    except TypeError as e:
        raise GeometryError("coordinates are not nested as the type asks") from e


def to_wkb(geometry: dict) -> bytes:
    """Little-endian WKB of a GeoJSON-like dict."""
    name = geometry["type"]
    head = b"\x01" + struct.pack("<I", CODES[name])
    if name == "GeometryCollection":
        members = [to_wkb(g) for g in geometry["geometries"]]
        return head + struct.pack("<I", len(members)) + b"".join(members)
    c = geometry["coordinates"]
    line = lambda p: struct.pack("<I", len(p)) + np.asarray(p, "<f8").tobytes()
    if name == "Point":
        return head + struct.pack("<2d", *c)
    if name == "LineString":
        return head + line(c)
    if name == "Polygon":
        return head + struct.pack("<I", len(c)) + b"".join(map(line, c))
    part = _PARTS[name]
    return head + struct.pack("<I", len(c)) + b"".join(to_wkb({"type": part, "coordinates": x}) for x in c)


def number(x: float) -> str:
    """The shortest text that reads back as the number, without a trailing .0."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x)) if x or math.copysign(1, x) > 0 else "-0"
    return repr(x)


def to_wkt(geometry: dict) -> str:
    name = geometry["type"]
    upper = name.upper()
    if name == "GeometryCollection":
        return f"{upper}({','.join(map(to_wkt, geometry['geometries']))})" if geometry["geometries"] else f"{upper} EMPTY"
    c = geometry["coordinates"]
    if name == "Point" and any(map(math.isnan, c)) or name != "Point" and not c:
        return f"{upper} EMPTY"

    def text(v) -> str:
        if v and not isinstance(v[0], list):
            return " ".join(map(number, v))
        return ",".join(f"({text(x)})" if name == "MultiPoint" or x and isinstance(x[0], list) or not x else text(x) for x in v)

    return f"{upper}({text(c)})"


_TOKEN = re.compile(r"\s*([A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),])")


def from_wkt(text: str) -> dict:
    """Reads WKT with or without SRID and Z, M or ZM; EMPTY parts become empty lists."""
    text = re.sub(r"^\s*SRID\s*=\s*\d+\s*;", "", text, flags=re.I)
    tokens, at = [], 0
    end = len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise GeometryError(f"invalid WKT {text[:60]!r}")
        tokens.append(m[1])
        at = m.end()
    out, used = _wkt(tokens, 0, text)
    if used != len(tokens):
        raise GeometryError(f"invalid WKT {text[:60]!r}")
    return out


_UPPER = {n.upper(): n for n in CODES}


def _wkt(t: list[str], i: int, text: str) -> tuple[dict, int]:
    bad = GeometryError(f"invalid WKT {text[:60]!r}")

    def at(k: int) -> str:
        if k >= len(t):
            raise bad
        return t[k].upper()

    word = at(i)
    for tail in ("ZM", "Z", "M"):
        if word not in _UPPER and word.endswith(tail) and word[: -len(tail)] in _UPPER:
            word = word[: -len(tail)]
            break
    if word not in _UPPER:
        raise bad
    name, i = _UPPER[word], i + 1
    if i < len(t) and at(i) in ("Z", "M", "ZM"):
        i += 1
    empty = i < len(t) and at(i) == "EMPTY"

    def position(k: int) -> tuple[list[float], int]:
        values = []
        while k < len(t) and t[k] not in "(),":
            try:
                values.append(float(t[k]))
            except ValueError as e:
                raise bad from e
            k += 1
        if not 2 <= len(values) <= 4:
            raise bad
        return values[:2], k

    def listed(k: int, item) -> tuple[list, int]:
        if at(k) == "EMPTY":
            return [], k + 1
        if at(k) != "(":
            raise bad
        out, k = [], k + 1
        while True:
            value, k = item(k)
            out.append(value)
            if at(k) == ")":
                return out, k + 1
            if at(k) != ",":
                raise bad
            k += 1

    def loose(k: int) -> tuple[list[float], int]:  # MULTIPOINT takes both (1 2) and 1 2
        if at(k) == "(":
            value, k = position(k + 1)
            if at(k) != ")":
                raise bad
            return value, k + 1
        return position(k)

    line = lambda k: listed(k, position)
    if name == "Point":
        if empty:
            return {"type": name, "coordinates": [math.nan, math.nan]}, i + 1
        values, i = listed(i, position)
        if len(values) != 1:
            raise bad
        return {"type": name, "coordinates": values[0]}, i
    if name == "GeometryCollection":
        members, i = listed(i, lambda k: _wkt(t, k, text))
        return {"type": name, "geometries": members}, i
    item = {"LineString": position, "MultiPoint": loose, "Polygon": line, "MultiLineString": line, "MultiPolygon": lambda k: listed(k, line)}[name]
    values, i = listed(i, item)
    return {"type": name, "coordinates": values}, i


def decode(value, encoding: str = "") -> dict | None:
    """A geometry of bytes or text; null or empty bytes give None. Without an encoding the value's
    type decides."""
    if value is None:
        return None
    encoding = encoding or ("WKB" if isinstance(value, (bytes, bytearray, memoryview)) else "WKT" if isinstance(value, str) else "")
    if encoding.upper() == "WKB":
        if not isinstance(value, (bytes, bytearray, memoryview)):
            raise GeometryError(f"expected bytes for wkb geometry, got {type(value).__name__}")
        return from_wkb(bytes(value)) if len(value) else None
    if encoding.upper() == "WKT":
        if not isinstance(value, str):
            raise GeometryError(f"expected string for wkt geometry, got {type(value).__name__}")
        return from_wkt(value)
    raise GeometryError(f"unsupported encoding: {encoding}")


def bounds_of(arrays: list[np.ndarray]) -> tuple[float, float, float, float] | None:
    """xmin, ymin, xmax, ymax; None where there is no point with numbers."""
    arrays = [a for a in arrays if len(a)]
    if not arrays:
        return None
    all_ = np.concatenate(arrays)
    all_ = all_[~np.isnan(all_).any(axis=1)]
    if not len(all_):
        return None
    low, high = all_.min(axis=0), all_.max(axis=0)
    return float(low[0]), float(low[1]), float(high[0]), float(high[1])


def wkb_bounds(data: bytes) -> tuple[float, float, float, float] | None:
    return bounds_of(_flat(parse_wkb(data)))


def orientation(ring: np.ndarray) -> int:
    """1 counterclockwise, -1 clockwise, 0 neither, by signed area around the first point."""
    if len(ring) < 3:
        return 0
    d = np.asarray(ring, float) - ring[0]
    area = float((d[:-1, 0] * d[1:, 1] - d[1:, 0] * d[:-1, 1]).sum())
    return (area > 0) - (area < 0)


def rings_follow(geometry, every_polygon: bool = False) -> str:
    """"", "exterior" or "interior": the first kind of ring of a polygon that turns the wrong way.
    Polygons of a multi-polygon count only if `every_polygon`."""
    name, parts = geometry
    if name == "Polygon":
        for i, ring in enumerate(parts):
            if orientation(ring) != (1 if i == 0 else -1):
                return "interior" if i else "exterior"
    elif every_polygon and name in ("MultiPolygon", "GeometryCollection"):
        return next((w for p in parts if (w := rings_follow(p, True))), "")
    return ""
