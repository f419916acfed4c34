import json
import os
import struct
import subprocess
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from terravane import cli
from terravane.errors import DuplicateMetadataError, FeatureError, MetadataError, NoMetadataError, TerravaneError
from terravane.functions import geometry as g
from terravane.metadata import GeoMetadata, crs_name, footer_value
from terravane.operators import describe as describing
from terravane.operators import transform as transforming
from terravane.operators.convert import convert
from terravane.operators.extract import extract
from terravane.operators.validate import validate
from terravane.plans import boxes
from terravane.sources import footers, geojson, geoparquet, schema, storage

point = lambda x, y: {"type": "Point", "coordinates": [x, y]}
feature = lambda geometry=None, **p: {"type": "Feature", "properties": p, "geometry": geometry}
collection = lambda *f: {"type": "FeatureCollection", "features": list(f)}
square = lambda x, y, s=1: {"type": "Polygon", "coordinates": [[[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]]}
#: Five places in the manner of a table of countries: west, east, and one that is far.
PLACES = [("Isle", "Oceania", {"type": "MultiPolygon", "coordinates": [square(178, -18)["coordinates"], square(-180, -17)["coordinates"]]}), ("Savanna", "Africa", square(34, -7, 2)), ("Dunes", "Africa", square(-13, 24)), ("North", "America", {"type": "MultiPolygon", "coordinates": [square(-100, 60, 9)["coordinates"]]}), ("Delta", "America", square(-92, 32, 3))]


@pytest.fixture
def put(tmp_path):
    def write(name, value):
        path = tmp_path / name
        path.write_text(value if isinstance(value, str) else json.dumps(value))
        return str(path)

    return write


@pytest.fixture
def places(put):
    return put("places.geojson", collection(*(feature(s, name=n, continent=c, pop=float(i)) for i, (n, c, s) in enumerate(PLACES))))


def same(a, b):
    return json.loads(json.dumps(a)) == json.loads(json.dumps(b))


GOOD = {
    "collection": (collection(feature(point(1, 2), a=1)), [(point(1, 2), {"a": 1}, None)]),
    "feature": ({**feature(point(1, 2), n="x"), "id": "k"}, [(point(1, 2), {"n": "x"}, "k")]),
    "number id": ({"id": 7, **feature(None)}, [(None, {}, 7)]),
    "geometry": (point(3, 4), [(point(3, 4), {}, None)]),
    "coordinates first": ('{"coordinates":[3,4],"type":"Point"}', [(point(3, 4), {}, None)]),
    "geometries": ({"type": "GeometryCollection", "geometries": [point(1, 2), point(3, 4)]}, [({"type": "GeometryCollection", "geometries": [point(1, 2), point(3, 4)]}, {}, None)]),
    "sequence": ("\n".join(json.dumps(feature(point(i, i), i=i)) for i in range(3)), [(point(i, i), {"i": i}, None) for i in range(3)]),
    "others ignored": ({"x": [[1], {"y": 2}], "crs": {"a": {"b": 1}}, **collection(feature(None, b=True))}, [(None, {"b": True}, None)]),
    "empty": (collection(), []),
    "nothing": ("", []),
    "any id in a collection": (collection({"id": True, **feature(None)}), [(None, {}, True)]),
    "z is dropped": (feature({"type": "Point", "coordinates": [1, 2, 3]}), [(point(1, 2), {}, None)]),
    "behind features": ('{"type":"FeatureCollection","features":[],"type":7}', []),
}


@pytest.mark.parametrize("name", GOOD)
def test_reading_forms(name):
    text, want = GOOD[name]
    got = [(f["geometry"], f["properties"], f["id"]) for f in geojson.features_of(text if isinstance(text, str) else json.dumps(text))]
    assert same(got, want)


BAD = {
    "[1]": "expected a JSON object, got \\[",
    '{"a":1}': "expected a FeatureCollection, a Feature, or a Geometry object",
    '{"type":"Feature","features":[]}': 'found features in unexpected "Feature" type',
    '{"type":"Feature","geometries":[]}': 'found geometries in unexpected "Feature" type',
    '{"type":"Feature","type":"Feature"}': "found duplicate type",
    '{"properties":{},"properties":{}}': "found duplicate properties",
    '{"geometry":{"type":"Point","coordinates":[1,2]},"geometry":null}': "found duplicate geometry",
    '{"coordinates":[1,2],"coordinates":[1,2]}': "found duplicate coordinates",
    '{"id":1,"id":2}': "found duplicate id",
    '{"id":true,"geometry":null}': "expected id to be a string or number, got: true",
    '{"id":[1],"geometry":null}': "expected id to be a string or number",
    '{"type":"FeatureCollection","features":{}}': "expected an array of features",
    '{"type":"FeatureCollection","features":[{"type":"Feature"}]}': "geometry",
    '{"type":"FeatureCollection","features":[{"geometry":{"type":"Blob","coordinates":[]}}]}': "invalid geometry type",
    '{"geometry":null} {"type":"Point","coordinates":[1,2]}': "geometry",
    '{"type":"FeatureCollection","features":[': "unexpected end",
    '{"geometry":{"type":"Point"}}': "coordinates",
}


@pytest.mark.parametrize("text", BAD)
def test_reading_errors(text):
    with pytest.raises(FeatureError, match=BAD[text]):
        list(geojson.features_of(text))


def test_earlier_features_come_before_an_error():
    read = geojson.features_of(json.dumps(feature(point(1, 2))) + "\n{bad")
    assert next(read)["geometry"]
    with pytest.raises(FeatureError):
        next(read)


def inferred(*properties, least=1, most=5):
    return geojson.infer([{"properties": p} for p in properties], least, most)


def test_inference():
    got = inferred({"b": True, "n": 1, "s": "x", "l": [1.5], "o": {"z": "q", "a": 1}, "los": [{"k": "v"}]})
    assert got.simpleString() == "struct<b:boolean,geometry:binary,l:array<double>,los:array<struct<k:string>>,n:double,o:struct<a:double,z:string>,s:string>"
    assert inferred({"a": None, "b": []}, {"a": 1, "b": {}}, {"b": ["x"]}).simpleString() == "struct<a:double,b:array<string>,geometry:binary>"
    assert inferred() is None
    assert inferred({"a": [{}]}, {"a": [{"x": 1}]}).simpleString() == "struct<a:array<struct<x:double>>,geometry:binary>"
    for bad in ([{"a": None}], [{"a": None}] * 9, [{"a": [1, "x"]}], [{"a": {"b": None}}], [{"a": [None]}]):
        with pytest.raises(FeatureError):
            inferred(*bad)
    with pytest.raises(FeatureError, match="failed to create schema after reading 5 features"):
        inferred(*[{"a": None}] * 9)


def test_mismatch_is_an_error(spark, put):
    path = put("m.geojson", collection(feature(point(0, 0), p="x"), feature(point(0, 0), p=42)))
    with pytest.raises(Exception, match='expected "p" to be a string, got 42'):
        geojson.read(spark, path, 1, 5).collect()
    assert geojson.read(spark, path, 1, 5, permissive=True).count() == 1


def test_geojson_round_trip(spark, put, tmp_path):
    rows = collection(
        feature(point(1, 2), numbers=[1.0, 2.5], nested={"a": "x", "b": 3.0}, objects=[{"a": 1.0}], flag=True, text="t"),
        feature(None, numbers=[], nested=None, objects=None, flag=None, text=None),
    )
    out, back = str(tmp_path / "x.parquet"), str(tmp_path / "x.geojson")
    said = convert(spark, put("x.geojson", rows), out, min_features=1, single_file=True)
    assert said["records"] == 2 and said["geo"]["columns"]["geometry"]["bbox"] == [1, 2, 1, 2] and said["geo"]["columns"]["geometry"]["geometry_types"] == ["Point"]
    convert(spark, out, back, single_file=True)
    got = json.load(open(back))
    assert same(got["features"], rows["features"])
    assert os.path.isfile(out) and validate(spark, out).valid


def test_lines_are_split(spark, put, tmp_path):
    path = put("l.ndgeojson", "\n".join(json.dumps(feature(point(i, -i), num=i, id=i)) for i in range(500)) + "\n")
    df = geojson.read(spark, path)
    assert df.count() == 500 and dict(df.dtypes) == {"geometry": "binary", "id": "double", "num": "double"}
    out = str(tmp_path / "folder")
    convert(spark, path, out, target_format="geoparquet", single_file=False)
    assert validate(spark, out).valid and geoparquet.read(spark, out).count() == 500
    lines = str(tmp_path / "lines")
    geojson.write(geoparquet.read(spark, out), lines, single_file=False)
    assert spark.read.text(lines).count() == 500


def test_empty_collection(spark, put, tmp_path):
    out = str(tmp_path / "e.parquet")
    convert(spark, put("e.geojson", collection()), out, single_file=True)
    assert geoparquet.read(spark, out).count() == 0 and validate(spark, out).valid
    convert(spark, out, str(tmp_path / "e2.geojson"), single_file=True)
    assert json.load(open(tmp_path / "e2.geojson"))["features"] == []


def test_ids(spark, put):
    path = put("i.geojson", collection({"id": "k", **feature(None, a=1)}, {"id": 2, **feature(None, a=1)}))
    assert [r.id for r in geojson.read(spark, path, keep_id=True).collect()] == ['"k"', "2"]
    assert "id" not in geojson.read(spark, path).columns


@pytest.mark.parametrize("cap,groups", [(0, 1), (3, 4), (5, 2), (60, 1)])
def test_row_groups(spark, put, tmp_path, cap, groups):
    path = put("ten.geojson", collection(*(feature(point(i, i), num=i) for i in range(10))))
    out = str(tmp_path / "ten.parquet")
    convert(spark, path, out, row_group_length=cap, single_file=True)
    assert pq.ParquetFile(out).metadata.num_row_groups == groups
    if groups == 4:
        assert [r.num for r in geoparquet.read(spark, out, row_groups=[1]).collect()] == [3, 4, 5]
        assert geoparquet.read(spark, out, columns=["nope", "geometry"]).columns == ["geometry"]


@pytest.mark.parametrize("codec", geoparquet.CODECS)
def test_codecs(spark, put, tmp_path, codec):
    out = str(tmp_path / f"{codec}.parquet")
    convert(spark, put("c.geojson", collection(feature(point(1, 2), a="x"))), out, compression=codec, single_file=True)
    assert pq.ParquetFile(out).metadata.row_group(0).column(0).compression.lower() == codec
    assert spark.read.parquet(out).count() == 1 or codec == "brotli"


def test_codec_errors_and_preservation(spark, tmp_path):
    with pytest.raises(TerravaneError, match="invalid compression codec"):
        geoparquet.codec("zip")
    source, out = str(tmp_path / "s.parquet"), str(tmp_path / "o.parquet")
    pq.write_table(pa.table({"geometry": [b"\x01\x01\x00\x00\x00" + bytes(16)], "n": [1]}), source, compression={"geometry": "gzip", "n": "snappy"})
    convert(spark, source, out, keep_codecs=True)
    assert geoparquet.column_codecs(out) == {"geometry": "gzip", "n": "snappy"}


@pytest.mark.parametrize("column", ["geometry", "geom"])
@pytest.mark.parametrize("text", [True, False])
def test_parquet_to_geoparquet(spark, tmp_path, column, text):
    source, out = str(tmp_path / "p.parquet"), str(tmp_path / "g.parquet")
    values = ["POINT(1 2)", None, "POINT(3 4)"]
    if not text:
        values = [g.to_wkb(g.from_wkt(v)) if v else None for v in values]
    pq.write_table(pa.table({"name": ["a", "b", "c"], column: values}), source)
    if column == "geom":
        with pytest.raises(MetadataError, match='expected a geometry column named "geometry"'):
            convert(spark, source, out)
    said = convert(spark, source, out, primary=column if column == "geom" else None)
    own = said["geo"]["columns"][column]
    assert said["geo"]["primary_column"] == column and own["encoding"] == "WKB"
    assert (own.get("bbox"), own["geometry_types"]) == (([1, 2, 3, 4], ["Point"]) if text else (None, []))
    assert convert(spark, source, out, primary=column, compute_stats=True)["geo"]["columns"][column]["bbox"] == [1, 2, 3, 4]
    assert spark.read.parquet(out).count() == 3 and validate(spark, out).valid


def test_all_null_text_has_no_bounds(spark, tmp_path):
    source, out = str(tmp_path / "n.parquet"), str(tmp_path / "o.parquet")
    pq.write_table(pa.table({"geometry": pa.array([None, None], pa.string())}), source)
    assert convert(spark, source, out)["geo"]["columns"]["geometry"] == {"encoding": "WKB", "geometry_types": []}


def test_nested_columns_pass_through(spark, tmp_path):
    table = pa.table({"sources": [[{"property": "p", "confidence": 0.5}], None], "bbox": [{"minx": 1.0}, {"minx": 2.0}], "d": pa.array([1, None], pa.decimal128(9, 2)), "geometry": [b"", None]})
    source, out = str(tmp_path / "n.parquet"), str(tmp_path / "o.parquet")
    pq.write_table(table, source)
    convert(spark, source, out)
    assert pq.read_table(out).to_pylist() == table.to_pylist()


def boxed_places(path, covering="", row_group_size=None, meta=True):
    rows = []
    for n, c, s in PLACES:
        b = g.wkb_bounds(g.to_wkb(s))
        rows.append({"continent": c, "name": n, "geometry": g.to_wkb(s), covering or "bbox": dict(zip(boxes.FIELDS, b))})
    geo = GeoMetadata.default()
    geo.raw["columns"]["geometry"]["bbox"] = [-180.0, -90.0, 180.0, 90.0]
    if covering:
        geo.raw["columns"]["geometry"]["covering"] = {"bbox": {f: [covering, f] for f in boxes.FIELDS}}
    table = pa.Table.from_pylist(rows)
    pq.write_table(table.replace_schema_metadata({"geo": geo.to_json()} if meta else {}), path, row_group_size=row_group_size)
    return path


@pytest.mark.parametrize("covering", ["", "extent"])
def test_extract_by_box_column(spark, tmp_path, covering):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    df = geoparquet.read(spark, boxed_places(str(tmp_path / "b.parquet"), covering, 1))
    assert boxes.bbox_column(df.schema, geoparquet.metadata_of(df)).name == (covering or "bbox")
    got = extract(df, "34,-7,36,-6", keep=["geometry", "name"])
    assert got.columns == ["name", "geometry"] and [r.name for r in got.collect()] == ["Savanna"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual({covering or 'bbox'}.xmax" in plan and "continent" not in plan.split("ReadSchema")[-1]
    assert [r.name for r in extract(df, "-92,32,-88,35").collect()] == ["Delta"]
    assert extract(df, "-92,32,-88,35", drop=["name", "zzz"]).columns == ["continent", "geometry", covering or "bbox"]


def test_extract_by_geometry(spark, places, tmp_path):
    out = str(tmp_path / "p.parquet")
    convert(spark, places, out)
    df = geoparquet.read(spark, out)
    assert [r.name for r in extract(df, "34,-7,36,-6").collect()] == ["Savanna"]
    for kwargs in ({"keep": ["name"]}, {"drop": ["geometry"]}, {"keep": ["geometry"], "drop": ["name"]}):
        with pytest.raises(TerravaneError):
            extract(df, **kwargs)
    kept = str(tmp_path / "k.parquet")
    geoparquet.write(extract(df, "34,-7,36,-6", keep=["geometry"]), kept, single_file=True)
    assert geoparquet.file_metadata(kept).raw == geoparquet.file_metadata(out).raw


def test_row_group_stats(spark, tmp_path):
    path = boxed_places(str(tmp_path / "b.parquet"), "", 2)
    got = geoparquet.row_group_stats(spark, path, "bbox.xmin").orderBy("row_group").collect()
    assert [(r.row_group, r.rows, r["min"], r["max"]) for r in got] == [(0, 2, -180, 34), (1, 2, -100, -13), (2, 1, -92, -92)]
    assert geoparquet.row_group_stats(spark, path).where("column = 'bbox.ymax'").count() == 3


def test_metadata():
    pairs = [("geo", '{"version":"0.4.0","columns":{"g":{"geometry_type":"Point"},"h":{"geometry_type":["Point","Polygon"]},"i":{"geometry_types":[1]}},"x":1}')]
    m = GeoMetadata.of_footer(pairs)
    assert [m.geometry_types(n) for n in "ghij"] == [["Point"], ["Point", "Polygon"], [], []] and m.raw["x"] == 1
    with pytest.raises(NoMetadataError):
        footer_value([("a", "b")])
    with pytest.raises(DuplicateMetadataError):
        footer_value(pairs * 2)
    for bad in ("[", "[]", '{"columns":3}', '{"columns":{"a":1}}', '{"version":1}'):
        with pytest.raises(MetadataError):
            GeoMetadata.parse(bad)
    assert [crs_name(c) for c in ({"name": "n"}, {"id": {"authority": "A", "code": "B"}}, {"id": {"authority": "EPSG", "code": 4326}}, {}, None)] == ["n", "A:B", "EPSG:4326", "Unknown", "Unknown"]
    assert m.clone().raw == m.raw and m.only(["g"]).columns.keys() == {"g"}


def test_formats_and_schemes(tmp_path):
    assert [storage.format_of(n).value for n in ("a.g" + "pq", "a.geoparquet", "a.pq", "a.parquet", "a.geojson", "a.ndjson", "https://h/a.parquet?q=1", "a.PARQUET", "a")] == ["geoparquet", "geoparquet", "parquet", "parquet", "geojson", "geojson", "parquet", "", ""]
    assert storage.readable("s3://b/k") == "s3a://b/k" and storage.readable("azblob://c/k?storage_account=a") == "abfss://c@a.dfs.core.windows.net/k" and storage.readable("/x") == "/x"
    with pytest.raises(TerravaneError):
        storage.readable("ftp://x/y")


def test_http_source(spark, places, tmp_path):
    import functools
    import http.server
    import threading

    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path))
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        url = f"http://127.0.0.1:{server.server_port}/places.geojson?x=1"
        assert geojson.read(spark, url).count() == 5
        with pytest.raises(TerravaneError):
            storage.readable(url.replace("places", "none"))
        server.shutdown()


def test_schema_text(tmp_path):
    path = str(tmp_path / "s.parquet")
    fields = [pa.field("b", pa.binary()), pa.field("i", pa.int32()), pa.field("r", pa.bool_(), nullable=False), pa.field("s", pa.string()), pa.field("l", pa.list_(pa.float64())), pa.field("o", pa.struct([("x", pa.float32())])), pa.field("f", pa.binary(3)), pa.field("d", pa.decimal128(9, 2)), pa.field("u", pa.uint8()), pa.field("t", pa.timestamp("ms", "UTC"))]
    pq.ParquetWriter(path, pa.schema(fields)).close()
    text = schema.message(pq.ParquetFile(path).schema)
    for line in ("message {", "  optional binary b;", "  optional int32 i;", "  required boolean r;", "  optional binary s (STRING);", "  optional group l (LIST) {", "    repeated group list {", "      optional double element;", "  optional group o {", "    optional float x;", "  optional fixed_len_byte_array (3) f;", "  optional fixed_len_byte_array (4) d (DECIMAL (9, 2));", "  optional int32 u (INT (8, false));", "  optional int64 t (TIMESTAMP (MILLIS, true));"):
        assert line in text.split("\n"), line
    root = schema.tree(pq.ParquetFile(path).schema)
    assert schema.list_element(root.child("l")).physical == "double" and schema.leaf(root, "o.x").physical == "float" and schema.leaf(root, "o.y") is None
    assert describing.info(path)["schema"]["fields"][0] == {"name": "b", "optional": True, "type": "binary", "compression": "unknown"}


def test_describe(spark, tmp_path):
    path = boxed_places(str(tmp_path / "b.parquet"), "", 2)
    found = describing.info(path)
    assert (found["rows"], found["groups"], found["issues"]) == (5, 3, []) and found["metadata"]["version"] == "1.0.0"
    rows = {r.path: r for r in describing.describe(spark, path).collect()}
    assert rows["geometry"].type == "binary" and rows["name"].annotation == "string" and rows["bbox"].annotation == "group" and rows["bbox.xmin"].compression == "snappy"
    assert "Row Groups: 3" in describing.text(found) and "0..1" in describing.text(found)
    assert "missing" in describing.info(boxed_places(str(tmp_path / "n.parquet"), meta=False))["issues"][0]
    bad = str(tmp_path / "bad.parquet")
    pq.write_table(pa.table({"a": [1]}).replace_schema_metadata({"geo": "{"}), bad)
    assert "invalid" in describing.info(bad)["issues"][0]
    with pytest.raises(TerravaneError):
        describing.info(str(tmp_path / "none.parquet"))


def test_stream(spark, tmp_path):
    from terravane.streaming.extract import extract_stream

    os.mkdir(tmp_path / "in")
    boxed_places(str(tmp_path / "in" / "a.parquet"))
    out = extract_stream(spark, str(tmp_path / "in"), "34,-7,36,-6", keep=["geometry", "name"])
    query = out.writeStream.format("memory").queryName("found").start()
    query.processAllAvailable()
    query.stop()
    assert [r.name for r in spark.table("found").collect()] == ["Savanna"]


def test_command_line(spark, places, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(sys.stdin, "isatty", lambda: True, raising=False)
    out, cut, back = (str(tmp_path / n) for n in ("o.parquet", "c.parquet", "b.geojson"))
    assert cli.main(["convert", places, out]) == 0
    assert cli.main(["extract", out, cut, "--bbox", "34,-7,36,-6", "--drop-cols", "pop"]) == 0
    assert cli.main(["convert", cut, back]) == 0
    assert [f["properties"] for f in json.load(open(back))["features"]] == [{"continent": "Africa", "name": "Savanna"}]
    assert cli.main(["validate", out]) == 0 and "Passed 20 checks." in capsys.readouterr().out
    assert cli.main(["validate", "--metadata-only", "--format", "json", out]) == 0
    assert json.loads(capsys.readouterr().out)["metadataOnly"] is True
    assert cli.main(["describe", out]) == 0 and "Rows: 5" in capsys.readouterr().out
    assert cli.main(["describe", "--format", "json", out]) == 0 and json.loads(capsys.readouterr().out)["rows"] == 5
    assert cli.main(["describe", "--metadata-only", out]) == 0 and json.loads(capsys.readouterr().out)["primary_column"] == "geometry"
    assert cli.main(["version"]) == 0
    for bad in (["convert", out, out], ["convert", places, str(tmp_path / "x.txt")], ["extract", out, out], ["extract", out, cut, "--bbox", "1,2"]):
        assert cli.main(bad) == 1
    pq.write_table(pa.table({"a": [1]}), cut)
    assert cli.main(["validate", cut]) == 1


def test_package_runs_without_llm(tmp_path):
    code = "import sys; sys.modules['terravane.llm'] = None; import __spark_entry__ as e; assert 'extract_bbox_column' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_point_bytes():
    assert g.to_wkb(point(1, 2)) == struct.pack("<BI2d", 1, 1, 1, 2)


def test_suffixes_are_exact():
    assert [storage.format_of(n).value for n in ("a.geopq", "a.gparquet", "a.pq2")] == ["", "", ""]


def test_azure_account(monkeypatch):
    monkeypatch.delenv("AZURE_STORAGE_ACCOUNT", raising=False)
    with pytest.raises(TerravaneError, match="storage account"):
        storage.readable("azblob://c/k")
    monkeypatch.setenv("AZURE_STORAGE_ACCOUNT", "mine")
    assert storage.readable("azblob://c/a/k") == "abfss://c@mine.dfs.core.windows.net/a/k"


@pytest.fixture
def served(tmp_path):
    """A server with ranges and validators, and what was asked of it."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    asked: list[tuple[str, str]] = []
    state = {"tag": '"1"', "ranges": True}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            path = tmp_path / self.path.lstrip("/")
            if not path.exists():
                return self.send_error(404)
            data, span, code = path.read_bytes(), self.headers.get("Range", ""), 200
            asked.append((span, self.headers.get("If-Range", "")))
            if span and state["ranges"] and self.headers.get("If-Range", state["tag"]) == state["tag"]:
                a, _, b = span.removeprefix("bytes=").partition("-")
                a, b = (max(0, len(data) - int(b)), len(data) - 1) if not a else (int(a), min(int(b), len(data) - 1))
                code, total = 206, len(data)
                data = data[a : b + 1]
            self.send_response(code)
            if code == 206:
                self.send_header("Content-Range", f"bytes {a}-{b}/{total}")
            self.send_header("ETag", state["tag"])
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}", asked, state
    server.shutdown()


def test_http_ranges(spark, served, tmp_path):
    url, asked, state = served
    data = bytes(i * 7 % 251 for i in range(1 << 20))
    (tmp_path / "raw").write_bytes(data)
    file = storage.HttpFile(f"{url}/raw")
    assert file.size() == len(data) and file.read(3) == data[:3]
    assert file.seek(-5, 2) == len(data) - 5 and file.read() == data[-5:] and file.read(1) == b""
    file.seek(300_000)
    assert file.read(200_000) == data[300_000:500_000] and file.tell() == 500_000
    assert sum(1 for span, tag in asked[1:] if tag != '"1"') == 0
    state["tag"] = '"2"'
    file.seek(100_000)
    with pytest.raises(TerravaneError, match="has changed"):
        file.read(1)
    with pytest.raises(ValueError):
        file.seek(-1)
    with pytest.raises(TerravaneError, match="404"):
        storage.HttpFile(f"{url}/none")
    state["ranges"] = False
    assert storage.HttpFile(f"{url}/raw").read() == data


def test_tables_over_http(spark, served, tmp_path):
    """Row groups are read by ranges: fewer bytes than the file has."""
    url, asked, _ = served
    n = 60_000
    at = str(tmp_path / "t.parquet")
    df = spark.range(n).selectExpr("id", "sha2(cast(id AS string), 256) AS text", "cast(null AS binary) AS geometry").coalesce(1)
    geoparquet.write(df, at, compression="uncompressed", row_group_length=10_000, single_file=True)
    asked.clear()
    got = geoparquet.read(spark, f"{url}/t.parquet", columns=["id", "geometry"], row_groups=[2])
    assert sorted(r.id for r in got.collect()) == list(range(20_000, 30_000)) and got.columns == ["id", "geometry"]
    assert describing.info(f"{url}/t.parquet")["rows"] == n
    taken = sum(int(s.removeprefix("bytes=-")) if s.startswith("bytes=-") else int(s.split("-")[1]) - int(s.removeprefix("bytes=").split("-")[0]) + 1 for s, _ in asked)
    assert taken < os.path.getsize(at) / 3
    assert geoparquet.metadata_of(got).primary_column == "geometry"
    assert validate(spark, f"{url}/t.parquet").valid


def test_row_groups_of_files_of_one_name(spark, tmp_path):
    for k, length in ((1, 2), (2, 3)):
        (tmp_path / f"k={k}").mkdir()
        df = spark.range(7).selectExpr("id", "cast(null AS binary) AS geometry").coalesce(1)
        geoparquet.write(df, f"{tmp_path}/k={k}/part-0.parquet", row_group_length=length, single_file=True)
    rows = geoparquet.read(spark, str(tmp_path), row_groups=[0]).collect()
    assert sorted((r.k, r.id) for r in rows) == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]
    rows = geoparquet.read(spark, str(tmp_path), row_groups=[1, 3]).collect()
    assert sorted((r.k, r.id) for r in rows) == [(1, 2), (1, 3), (1, 6), (2, 3), (2, 4), (2, 5)]
    assert footers.totals(spark, str(tmp_path)) == (14, 7)


def test_box_prunes_row_groups(spark, tmp_path):
    """Of two row groups, one a hemisphere, a box keeps that it can be in; without a box column it's an error."""
    at = str(tmp_path / "halves.parquet")
    box = "named_struct('xmin', x, 'ymin', y, 'xmax', x + 1, 'ymax', y + 1) AS bbox"
    df = spark.range(200).selectExpr("id", "cast(if(id < 100, -150 + id, 20 + id % 100) AS double) AS x", "cast(id % 50 AS double) AS y").coalesce(1)
    geoparquet.write(df.selectExpr("id", box, "cast(null AS binary) AS geometry"), at, row_group_length=100, single_file=True)
    kept = lambda b: sorted(r.row_group for r in boxes.row_groups_meeting(spark, at, b).collect())
    from terravane.functions.bbox import Bbox

    assert kept(Bbox(34, -7, 36, 6)) == [1] and kept(Bbox(-94, 28, -88, 33)) == [0] and kept(Bbox(-180, -90, 180, 90)) == [0, 1] and kept(Bbox(150, 80, 160, 85)) == []
    assert {r.id for r in boxes.extract_row_groups(spark, at, Bbox(34, -7, 36, 6)).collect()} == set(range(100, 200))
    bare = str(tmp_path / "bare.parquet")
    geoparquet.write(df.selectExpr("id", "cast(null AS binary) AS geometry"), bare, single_file=True)
    with pytest.raises(TerravaneError, match="no bbox column"):
        boxes.row_groups_meeting(spark, bare, Bbox(0, 0, 1, 1))


def _footer(pairs):
    """A footer in Thrift's compact protocol: a version, an empty list, a count, the pairs."""

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    text = lambda x: number(len(x.encode())) + x.encode()
    items = b"".join(b"\x18" + text(k) + b"\x18" + text(v) + b"\x00" for k, v in pairs)
    return b"\x15\x02" + b"\x19\x0c" + b"\x16\x00" + b"\x29" + (bytes([len(pairs) << 4 | 12]) if len(pairs) < 15 else b"\xfc" + number(len(pairs))) + items + b"\x00"


def test_keys_of_a_footer(tmp_path):
    for found in ([], [("geo", "{}")], [("geo", "{}"), ("a", "é" * 200), ("geo", "[]")], [(f"k{i}", "v") for i in range(20)]):
        assert footers.pairs_of(_footer(found)) == found
        body = _footer(found)
        path = tmp_path / "x.parquet"
        path.write_bytes(b"PAR1" + body + len(body).to_bytes(4, "little") + b"PAR1")
        assert footers.pairs(str(path)) == found
    with pytest.raises(DuplicateMetadataError):
        footer_value(footers.pairs_of(_footer([("geo", "{}"), ("geo", "{}")])))
    for bad in (b"", b"PAR1", b"PAR1\xff\xff\x00\x00PAR1", b"PAR1\x19\x01\x00\x00\x00PAR1"):
        (tmp_path / "x.parquet").write_bytes(bad)
        with pytest.raises(TerravaneError):
            footers.pairs(str(tmp_path / "x.parquet"))
    real = str(tmp_path / "real.parquet")
    pq.write_table(pa.table({"a": [1]}).replace_schema_metadata({"geo": "x", "b": "y"}), real)
    assert dict(footers.pairs(real)).items() >= {"geo": "x", "b": "y"}.items()


def test_collection_over_several_lines(spark, put):
    """A file that isn't lines is read whole, wherever its lines end."""
    path = put("pretty.geojson", json.dumps(collection(*(feature(point(i, i), n=i) for i in range(3))), indent=2))
    assert sorted(r.n for r in geojson.read(spark, path).collect()) == [0, 1, 2]


def test_ids_are_written(spark, put, tmp_path):
    path = put("ids.ndgeojson", "\n".join(json.dumps({**feature(point(i, i), n=i), **({} if v is None else {"id": v})}) for i, v in enumerate(["a", 7, "7", None])))
    df = geojson.read(spark, path, keep_id=True)
    out = str(tmp_path / "ids.geojson")
    geojson.write(df, out, single_file=True, id_column="id")
    features = json.load(open(out))["features"]
    assert {f["properties"]["n"]: f.get("id", ...) for f in features} == {0: "a", 1: 7, 2: "7", 3: ...}
    assert all("id" not in f["properties"] for f in features)


def test_required_geometry_and_text_output(spark, tmp_path):
    df = spark.createDataFrame([(1, g.to_wkb(point(1, 2))), (2, None)], "n int, geometry binary")
    out = str(tmp_path / "r.parquet")
    with pytest.raises(Exception, match="unexpected null in required geometry column"):
        geoparquet.write(df, out, single_file=True, required=["geometry"])
    geoparquet.write(df.where("n = 1"), out, single_file=True, required=["geometry"], encoding="WKT")
    file = pq.ParquetFile(out)
    assert not file.schema_arrow.field("geometry").nullable and file.read()["geometry"].to_pylist() == ["POINT(1 2)"]
    assert geoparquet.file_metadata(out).columns["geometry"]["encoding"] == "WKT"
    with pytest.raises(TerravaneError, match="unsupported geometry encoding"):
        geoparquet.write(df, out, encoding="x")


def test_transform(spark, tmp_path):
    from pyspark.sql import types as T

    source, out = str(tmp_path / "s.parquet"), str(tmp_path / "t.parquet")
    geoparquet.write(spark.createDataFrame([("1.5", 1, None), (None, 2, None)], "a string, b int, geometry binary"), source, codecs={"a": "gzip", "b": "snappy", "geometry": "zstd"}, single_file=True)
    wanted = T.StructType([T.StructField("number", T.DoubleType()), T.StructField("b", T.IntegerType()), T.StructField("geometry", T.BinaryType())])
    transforming.transform(spark, source, out, {"a": transforming.text_to_number}, wanted, single_file=True, row_group_length=1)
    assert sorted(map(tuple, spark.read.parquet(out).collect()), key=str) == [(1.5, 1, None), (None, 2, None)]
    assert geoparquet.column_codecs(out) == {"number": "zstd", "b": "snappy", "geometry": "zstd"} and pq.ParquetFile(out).num_row_groups == 2
    assert geoparquet.file_metadata(out).primary_column == "geometry"
    with pytest.raises(TerravaneError, match="unexpected number of fields in the output schema, got 1, expected 3"):
        transforming.transform(spark, source, out, schema=wanted[:1])
    with pytest.raises(TerravaneError, match="unexpected type for number, got string, expected double"):
        transforming.transform(spark, source, out, schema=wanted)
    with pytest.raises(TerravaneError, match="no columns named x"):
        transforming.transform(spark, source, out, {"x": transforming.text_to_number})
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        transforming.transformed(spark.createDataFrame([("x",)], "a string"), {"a": transforming.text_to_number}).collect()
    transforming.transform(spark, source, out, metadata=lambda _: None)
    with pytest.raises(NoMetadataError):
        geoparquet.file_metadata(out)


def test_pipes(spark, places, monkeypatch):
    """Standard input to standard output."""
    import io
    from types import SimpleNamespace

    def piped(args, data):
        out = SimpleNamespace(buffer=io.BytesIO())
        monkeypatch.setattr(sys, "stdin", SimpleNamespace(buffer=io.BytesIO(data), isatty=lambda: False))
        monkeypatch.setattr(sys, "stdout", out)
        try:
            assert cli.main(args) == 0
        finally:
            monkeypatch.undo()
        return out.buffer.getvalue()

    with open(places, "rb") as f:
        table = piped(["convert", "--from", "geojson", "--to", "geoparquet"], f.read())
    assert pq.read_table(io.BytesIO(table)).num_rows == 5
    cut = piped(["extract", "--bbox", "34,-7,36,-6"], table)
    assert pq.read_table(io.BytesIO(cut))["name"].to_pylist() == ["Savanna"]
    back = piped(["convert", "--from", "geoparquet", "--to", "geojson"], cut)
    assert [f["properties"]["name"] for f in json.loads(back)["features"]] == ["Savanna"]


def test_version_detail(capsys):
    assert cli.main(["version", "--detail"]) == 0 and json.loads(capsys.readouterr().out).keys() == {"version", "commit", "date"}


ODD_TEXTS = ['},{"a":[', '\\', '\\"', "],", '"features":[', "\U0001f600é", ""]


def odd_features(n):
    return [feature(point(i, i % 90), i=float(i), text=ODD_TEXTS[i % 7] * (i % 5), parts=[{"a": float(i)}]) for i in range(n)]


@pytest.mark.parametrize("tail", ["]}", '],"more":[[1,2],{"features":[{"a":1},{"b":2}]}]}'])
@pytest.mark.parametrize("indent", [None, 1])
def test_long_collections_are_split(spark, put, monkeypatch, tail, indent):
    from terravane.sources import splits

    monkeypatch.setattr(splits, "SPLIT", 4000)
    rows = odd_features(300)
    text = '{"name":"a [{\\"","type":"FeatureCollection","features":[' + " ,\n".join(json.dumps(f, ensure_ascii=bool(f["properties"]["i"] % 2), indent=indent) for f in rows) + tail
    df = geojson.read(spark, put("long.geojson", text))
    assert df.rdd.getNumPartitions() > 5
    got = [(r.i, r.text, r.parts[0].a) for r in df.collect()]
    assert got == [(f["properties"]["i"], f["properties"]["text"], float(i)) for i, f in enumerate(rows)]


@pytest.mark.parametrize("text", ["\n".join(json.dumps(f) for f in odd_features(40)), json.dumps({"a": "x" * 900, **collection(*odd_features(40))}), json.dumps(collection(feature(point(1, 2), text="y" * 5000), *odd_features(39))), json.dumps({"x": "y" * 500, **feature(point(1, 2), i=1.0)})])
def test_long_files_of_other_forms(spark, put, monkeypatch, text):
    from terravane.sources import splits

    monkeypatch.setattr(splits, "SPLIT", 500)
    assert geojson.read(spark, put("long.json", text), 1).count() == len(list(geojson.features_of(text)))


@pytest.mark.parametrize("change, message", [(lambda t: t[:-2], "unexpected end of JSON input"), (lambda t: t[:-2] + "}]", "invalid JSON|unexpected end"), (lambda t: t.replace(', {"type": "Feature", "properties": {"i": 30.0', ', 7, {"type": "Feature", "properties": {"i": 30.0'), "expected a feature, got 7"), (lambda t: t.replace('"i": 30.0', '"i": x'), "invalid JSON"), (lambda t: t.replace('"i": 30.0', '"i": "x"'), 'expected "i" to be a float64')])
def test_errors_in_long_collections(spark, put, monkeypatch, change, message):
    from terravane.sources import splits

    monkeypatch.setattr(splits, "SPLIT", 500)
    with pytest.raises(Exception, match=message):
        geojson.read(spark, put("bad.geojson", change(json.dumps(collection(*odd_features(40))))), 1).collect()


@pytest.mark.parametrize("n", [0, 1, 500])
def test_one_file_without_the_driver(spark, tmp_path, monkeypatch, n):
    from pyspark.sql.classic import dataframe

    seen = []
    collect = dataframe.DataFrame.collect
    monkeypatch.setattr(dataframe.DataFrame, "collect", lambda self: (seen.append(out := collect(self)), out)[1])
    monkeypatch.setattr(dataframe.DataFrame, "toLocalIterator", lambda *_, **__: pytest.fail("rows went to the driver"))
    out = tmp_path / "out.geojson"
    out.write_text("old")
    df = spark.range(n).selectExpr("id", "concat('n\u00e9', id) AS name", "cast(null AS binary) AS geometry").repartition(7).orderBy("id")
    geojson.write(geoparquet.with_metadata(df, GeoMetadata.default()), str(out), single_file=True)
    assert len(str(seen)) < 5000
    lines = [f'{{"geometry":null,"properties":{{"id":{i},"name":"né{i}"}},"type":"Feature"}}' for i in range(n)]
    assert out.read_text() == '{"type":"FeatureCollection","features":[' + ("\n" if n else "") + ",\n".join(lines) + "\n]}\n"
    assert os.listdir(tmp_path) == ["out.geojson"]


@pytest.mark.parametrize("name", ["geojson_schema", "convert_to_geojson", "convert_geojson_metadata"])
def test_queries_of_one_file_keep_rows_from_the_driver(spark, monkeypatch, name):
    from pyspark.sql.classic import dataframe

    from terravane import queries_files

    monkeypatch.setattr(queries_files, "_made", {})
    monkeypatch.setattr(dataframe.DataFrame, "toLocalIterator", lambda *_, **__: pytest.fail("rows went to the driver"))
    assert queries_files.queries()[name](spark, "/root/testdata/sf0.001").count()


def test_codecs_share_one_table(spark, monkeypatch):
    from pyspark.sql import functions as F

    from terravane import queries_files

    made, table = spark.sparkContext.accumulator(0), queries_files._table

    def counted(spark, sf_dir):
        def seen(k):
            made.add(1)
            return k

        df = table(spark, sf_dir)
        return df.withColumn("c_custkey", F.udf(seen, df.schema["c_custkey"].dataType)("c_custkey"))

    monkeypatch.setattr(queries_files, "_table", counted)
    rows = queries_files.file_codecs(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 5 and rows[0].n <= made.value < 2 * rows[0].n
