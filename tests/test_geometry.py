import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terravane.errors import GeometryError, TerravaneError
from terravane.functions import bbox, columns
from terravane.functions import geometry as g
from terravane.functions.bbox import Bbox

xy = st.tuples(*[st.floats(-1e6, 1e6, allow_nan=False).map(float)] * 2).map(list)
line = st.lists(xy, min_size=1, max_size=5)
ring = st.lists(xy, min_size=4, max_size=6)
simple = st.one_of(
    xy.map(lambda c: {"type": "Point", "coordinates": c}),
    line.map(lambda c: {"type": "LineString", "coordinates": c}),
    line.map(lambda c: {"type": "MultiPoint", "coordinates": c}),
    st.lists(ring, min_size=1, max_size=3).map(lambda c: {"type": "Polygon", "coordinates": c}),
    st.lists(line, min_size=1, max_size=3).map(lambda c: {"type": "MultiLineString", "coordinates": c}),
    st.lists(st.lists(ring, min_size=1, max_size=2), min_size=1, max_size=3).map(lambda c: {"type": "MultiPolygon", "coordinates": c}),
)
shapes = st.one_of(simple, st.lists(simple, min_size=1, max_size=3).map(lambda m: {"type": "GeometryCollection", "geometries": m}))


@settings(max_examples=200, deadline=None)
@given(shapes)
def test_round_trips(shape):
    assert g.from_wkb(g.to_wkb(shape)) == shape
    assert g.from_wkt(g.to_wkt(shape)) == shape
    assert g.from_geojson(shape) == shape


def test_other_forms_of_wkb():
    big = struct.pack(">BI2d", 0, 1, 3, 4)
    ewkb = struct.pack("<BII3d", 1, 1 | 0xA0000000, 4326, 1, 2, 9)
    iso_zm = struct.pack("<BI4d", 1, 3001, 1, 2, 8, 9)
    assert g.from_wkb(big)["coordinates"] == [3, 4]
    assert g.from_wkb(ewkb)["coordinates"] == g.from_wkb(iso_zm)["coordinates"] == [1, 2]
    for bad in (b"\x01", b"\x02" + big[1:], big[:-1], struct.pack("<BI", 1, 99), struct.pack("<BII", 1, 2, 1 << 30), struct.pack("<BII", 1, 7, 1) + big[:3]):
        with pytest.raises(GeometryError):
            g.from_wkb(bad)


def test_wkt_forms():
    assert g.from_wkt("SRID=4326; point z (1 2 3)") == {"type": "Point", "coordinates": [1, 2]}
    assert g.from_wkt("POINTZM(1 2 3 4)") == g.from_wkt(" Point M ( 1  2 3 ) ")
    assert g.from_wkt("MULTIPOINT(1 2, 3 4)") == g.from_wkt("MULTIPOINT((1 2),(3 4))")
    assert g.to_wkt(g.from_wkt("POINT EMPTY")) == "POINT EMPTY" and g.from_wkt("POLYGON EMPTY")["coordinates"] == []
    assert g.to_wkt({"type": "Point", "coordinates": [1.0, -0.5]}) == "POINT(1 -0.5)"
    for bad in ("", "POINT", "POINT(1)", "POINT(1 2", "POINT(1 2)x", "CIRCLE(1 2)", "LINESTRING(1 2,)", "POINT(1 2,3 4)", "POLYGON((1 2)"):
        with pytest.raises(GeometryError):
            g.from_wkt(bad)


def test_decode():
    assert g.decode(None) is None and g.decode(b"", "WKB") is None
    assert g.decode("POINT(1 2)") == g.decode(g.to_wkb({"type": "Point", "coordinates": [1, 2]}))
    for value, encoding in (("POINT(1 2)", "WKB"), (b"x", "WKT"), ("POINT(1 2)", "polyline"), (7, "")):
        with pytest.raises(GeometryError):
            g.decode(value, encoding)


def test_orientation():
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]], float)
    assert g.orientation(square) == 1 and g.orientation(square[::-1]) == -1 and g.orientation(square[:2]) == 0
    poly = lambda *rings: g.parse_wkb(g.to_wkb({"type": "Polygon", "coordinates": [r.tolist() for r in rings]}))
    assert g.rings_follow(poly(square, square[::-1])) == "" and g.rings_follow(poly(square, square)) == "interior" and g.rings_follow(poly(square[::-1])) == "exterior"
    many = g.parse_wkb(g.to_wkb({"type": "MultiPolygon", "coordinates": [[square[::-1].tolist()]]}))
    assert g.rings_follow(many) == "" and g.rings_follow(many, True) == "exterior"


BOXES = [
    ((0, 0, 1, 1), (1, 1, 2, 2), True), ((0, 0, 1, 1), (1.01, 0, 2, 1), False), ((0, 0, 4, 4), (1, 1, 2, 2), True), ((-180, -90, 180, 90), (5, 5, 6, 6), True),
    ((170, -10, -170, 10), (-175, 0, -174, 1), True), ((170, -10, -170, 10), (175, 0, 176, 1), False), ((170, -10, -170, 10), (160, -5, -175, 5), True), ((0, 0, 1, 1), (0, 2, 1, 3), False),
]


def test_boxes(spark):
    for a, b, meets in BOXES:
        assert Bbox(*map(float, a)).intersects(Bbox(*map(float, b))) is meets and Bbox(*map(float, b)).intersects(Bbox(*map(float, a))) is meets
    df = spark.createDataFrame([(tuple(map(float, b)),) for _, b, _ in BOXES] + [(None,)], f"box {columns.BOX}")
    for a, _, _ in BOXES:
        got = [r[0] for r in df.select(bbox.intersects(F.col("box"), Bbox(*map(float, a)))).collect()]
        assert got == [Bbox(*map(float, a)).intersects(Bbox(*map(float, b))) for _, b, _ in BOXES] + [None]
    wide = [r[0] for r in df.select(bbox.intersects(F.col("box"), Bbox(170, -10, -170, 10), wrap=True)).collect()]
    assert wide[5] is True
    assert Bbox.parse("") is None and Bbox.parse("34,-7,36,-6") == Bbox(34, -7, 36, -6)
    for bad in ("1,2,3", "1,2,3,x", "1,2,3,4,5"):
        with pytest.raises(TerravaneError):
            Bbox.parse(bad)


def test_column_functions(spark):
    texts = ["POINT(1 2)", "LINESTRING(0 0,3 1)", "POLYGON((0 0,1 0,1 1,0 0))", "MULTIPOINT((1 2),(3 4))", "GEOMETRYCOLLECTION(POINT(7 8))", "POINT EMPTY", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", columns.wkt_to_wkb("t").alias("b"))
    rows = df.select("t", columns.wkb_to_wkt("b").alias("back"), columns.geometry_type("b").alias("kind"), columns.envelope("b").alias("e"), columns.envelope("t").alias("te"), columns.geometry_error("b", "WKB").alias("bad")).collect()
    assert [r.back for r in rows] == texts
    assert [r.kind for r in rows] == ["Point", "LineString", "Polygon", "MultiPoint", "GeometryCollection", "Point", None]
    assert [tuple(r.e) if r.e else None for r in rows] == [(1, 2, 1, 2), (0, 0, 3, 1), (0, 0, 1, 1), (1, 2, 3, 4), (7, 8, 7, 8), None, None]
    assert all(r.e == r.te and r.bad is None for r in rows)
    big = spark.createDataFrame([(bytearray(struct.pack(">BI2d", 0, 1, 3, 4)),), (bytearray(struct.pack("<BI3d", 1, 0x80000001, 3, 4, 5)),), (bytearray(b"xx"),)], "b binary")
    assert [r[0] for r in big.select(columns.geometry_type("b")).collect()] == ["Point", "Point", None]
    assert math.isnan(g.from_wkt("POINT EMPTY")["coordinates"][0])
    points = spark.range(50).select(F.col("id"), F.lit(b"\x01\x01\x00\x00\x00" + struct.pack("<2d", 5, 6)).alias("b"))
    assert {tuple(r.e) for r in points.select(columns.envelope("b").alias("e")).collect()} == {(5, 6, 5, 6)}


def test_batches_agree_with_single_values():
    import random
    import struct

    import pyarrow as pa

    from terravane.functions import columns
    from terravane.functions.batches import Batch

    rng = random.Random(6)
    place = lambda: [rng.choice([rng.uniform(-180, 180), float(rng.randint(-9, 9)), 0.0]), rng.uniform(-90, 90)]
    values = [None, b"", g.to_wkb(g.from_wkt("POINT EMPTY")), g.to_wkb(g.from_wkt("LINESTRING EMPTY")), struct.pack(">BIdd", 0, 1, 3.0, 4.0)]
    for _ in range(300):
        ring = [place() for _ in range(rng.randint(1, 6))]
        ring.append(ring[0])
        shape = rng.choice([
            {"type": "Point", "coordinates": place()}, {"type": "LineString", "coordinates": [place() for _ in range(rng.randint(1, 9))]},
            {"type": "Polygon", "coordinates": [ring]}, {"type": "Polygon", "coordinates": [ring, ring]}, {"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [2, 2], [0, 0]]]},
            {"type": "MultiPoint", "coordinates": [place(), place()]}, {"type": "MultiPolygon", "coordinates": [[ring]]},
        ])
        values.append(rng.choice([g.to_wkb(shape)] * 9 + [None]))
    for part in (values, values[:2], [], [v for v in values if v and v[1] == 3]):
        array = pa.array([b"x", *part], pa.binary()).slice(1)
        boxes = [g.wkb_bounds(v) if v else None for v in part]
        assert [tuple(b.values()) if b else None for b in columns.envelope_array(array).to_pylist()] == boxes
        assert columns.ring_problems(Batch(array), array) == [g.rings_follow(g.parse_wkb(v)) if v else None for v in part]
        assert not any(array[int(i)].as_py() in (None, b"") for i in columns.unplain(array, ""))
