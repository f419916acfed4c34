"""Geometry functions over columns.

What a type code or a point needs is built from Spark's own expressions; the rest are Arrow
functions that see whole batches.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import GeometryError
from . import geometry as g
from .batches import Batch

BOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
_BOX = pa.struct([(n, pa.float64()) for n in ("xmin", "ymin", "xmax", "ymax")])


def _mapped(kind: str, arrow: pa.DataType, f):
    """An Arrow function that maps values one by one; null and empty give null."""

    @F.arrow_udf(kind)
    def apply(values: pa.Array) -> pa.Array:
        return pa.array([f(v) if v else None for v in values.to_pylist()], arrow)

    return apply


def wkt_to_wkb(c) -> Column:
    """Fails on text that is no geometry."""
    return _mapped("binary", pa.binary(), lambda v: g.to_wkb(g.from_wkt(v)))(c)


def wkb_to_wkt(c) -> Column:
    return _mapped("string", pa.string(), lambda v: g.to_wkt(g.from_wkb(v)))(c)


def wkb_to_geojson(c) -> Column:
    return _mapped("string", pa.string(), lambda v: geojson_text(g.from_wkb(v)))(c)


def geojson_text(value: dict) -> str:
    """Whole numbers without a fraction; a point without numbers has no coordinates."""

    def plain(v):
        if isinstance(v, list):
            return [plain(x) for x in v if not (isinstance(x, float) and np.isnan(x))]
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return int(v) if isinstance(v, float) and v == int(v) and abs(v) < 1e21 else v

    return json.dumps(plain(value), separators=(",", ":"))


def geojson_to_wkb(c) -> Column:
    return _mapped("binary", pa.binary(), lambda v: g.to_wkb(g.from_geojson(json.loads(v))))(c)


def envelope_array(values: pa.Array) -> pa.Array:
    """Envelopes of WKB or WKT values; plain shapes in bytes are read as whole arrays."""
    if pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type):
        return Batch(values).box_array(lambda i: g.wkb_bounds(values[i].as_py()))
    made = [g.wkb_bounds(g.to_wkb(g.from_wkt(v))) if v else None for v in values.to_pylist()]
    return pa.array([dict(zip(("xmin", "ymin", "xmax", "ymax"), box)) if box else None for box in made], _BOX)


def envelope(c) -> Column:
    """Box of WKB or WKT; null for null and for geometries without a point."""

    @F.arrow_udf(BOX)
    def apply(values: pa.Array) -> pa.Array:
        return envelope_array(values)

    return apply(c)


def point_envelope(x, y) -> Column:
    """Box of a point whose coordinates are columns: no Python."""
    x, y = F.col(x) if isinstance(x, str) else x, F.col(y) if isinstance(y, str) else y
    return F.struct(x.alias("xmin"), y.alias("ymin"), x.alias("xmax"), y.alias("ymax"))


def geometry_type(c) -> Column:
    """GeoJSON name of a WKB geometry's type, by its code alone: no Python. Further ordinates make no
    difference, as geometries are read in two dimensions."""
    c = F.col(c) if isinstance(c, str) else c
    head = F.hex(F.substring(c, 1, 5))
    byte = lambda i: F.substring(head, 2 * i + 1, 2)
    code = F.when(byte(0) == "01", F.concat(byte(4), byte(3), byte(2), byte(1))).otherwise(F.substring(head, 3, 8))
    number = F.conv(code, 16, 10).cast("long").bitwiseAND(F.lit(0x0FFFFFFF)) % 1000
    named = F.when(F.lit(False), F.lit(""))
    for k, name in g.NAMES.items():
        named = named.when(number == k, F.lit(name))
    return F.when(F.length(c) >= 5, named)


def ring_problem(c, every_polygon: bool = False) -> Column:
    """"", "exterior" or "interior": which ring of a polygon breaks counterclockwise orientation."""

    @F.arrow_udf("string")
    def apply(values: pa.Array) -> pa.Array:
        return pa.array(ring_problems(Batch(values), values, every_polygon), pa.string())

    return apply(c)


def ring_problems(batch: Batch, values: pa.Array, every_polygon: bool = False) -> list[str | None]:
    """Of each value; null for null and empty."""
    out = np.full(len(values), "", object)
    out[batch.empty] = None
    turns = np.full(len(values), 1)
    turns[batch.plain] = batch.turns()
    out[(batch.kind == 3) & (turns < 1)] = "exterior"
    for i in np.flatnonzero(~batch.empty & (~batch.plain | ((batch.kind == 3) & (turns == 2)))):
        out[i] = g.rings_follow(g.parse_wkb(values[int(i)].as_py()), every_polygon)
    return out.tolist()


def geometry_error(c, encoding: str = "") -> Column:
    """Why a value is no geometry of the encoding; null if it is one, or null, or empty."""

    @F.arrow_udf("string")
    def apply(values: pa.Array) -> pa.Array:
        out: list[str | None] = [None] * len(values)
        for i in unplain(values, encoding):
            try:
                g.decode(values[int(i)].as_py(), encoding)
            except (GeometryError, ValueError, TypeError) as e:
                out[i] = str(e)
        return pa.array(out, pa.string())

    return apply(c)


def unplain(values: pa.Array, encoding: str) -> np.ndarray:
    """Places of the values that must be looked at one by one."""
    if encoding.upper() in ("", "WKB") and (pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type)):
        batch = Batch(values)
        return np.flatnonzero(~batch.plain & ~batch.empty)
    return np.arange(len(values))
