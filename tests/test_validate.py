"""The rules, one case each: metadata, rows, and what the report says."""

import copy
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from terravane.functions import geometry as g
from terravane.operators.validate import METADATA_RULES, TITLES, validate

RING = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]
HOLE = [[2.0, 2.0], [2.0, 4.0], [4.0, 4.0], [4.0, 2.0], [2.0, 2.0]]
poly = lambda *rings: {"type": "Polygon", "coordinates": list(rings)}
point = lambda x, y: {"type": "Point", "coordinates": [x, y]}
BASE = {"version": "1.0.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": []}}}
DATUM = {"type": "GeodeticReferenceFrame", "name": "World Geodetic System 1984", "ellipsoid": {"name": "WGS 84", "semi_major_axis": 6378137, "inverse_flattening": 298.257223563}}
ALL = {"encoding": "WKB", "geometry_types": ["Point", "Polygon"], "crs": {"$schema": "https://proj.org/schemas/v0.6/projjson.schema.json", "type": "GeographicCRS", "name": "WGS 84 longitude-latitude", "datum": DATUM, "id": {"authority": "OGC", "code": "CRS84"}}, "orientation": "counterclockwise", "edges": "planar", "bbox": [0, 0, 10, 10], "epoch": 2021.5}
ROWS = [point(5, 5), poly(RING, HOLE), None]


def meta(drop=(), top=None, **column):
    out = copy.deepcopy(BASE)
    out["columns"]["geometry"].update(column)
    out.update(top or {})
    for name in drop:
        out.pop(name, None)
        out["columns"]["geometry"].pop(name, None) if "columns" in out else None
    return out


CASES = {
    "all given": (meta(**ALL), ROWS, {}, 20),
    "least": (meta(), ROWS, {}, 20),
    "not an object": ([], ROWS, {2: "failed to parse file metadata as a JSON object"}, 2),
    "missing columns": (meta(["columns"]), ROWS, {5: 'missing "columns" in metadata'}, 5),
    "columns of another type": (meta(top={"columns": "x"}), ROWS, {5: 'expected "columns" to be an object, got "x"'}, 5),
    "column of another type": (meta(top={"columns": {"geometry": [1]}}), ROWS, {5: 'expected column "geometry" to be an object, got [1]'}, 5),
    "missing version": (meta(["version"]), ROWS, {3: 'missing "version" in metadata'}, 20),
    "version of another type": (meta(top={"version": 42}), ROWS, {3: 'expected "version" to be a string, got 42'}, 20),
    "empty version": (meta(top={"version": ""}), ROWS, {3: 'expected "version" to be a non-empty string'}, 20),
    "missing primary": (meta(["primary_column"]), ROWS, {4: 'missing "primary_column" in metadata', 6: 'the "" column is not included in the column metadata'}, 20),
    "unknown primary": (meta(top={"primary_column": "g"}), ROWS, {6: 'the "g" column is not included in the column metadata'}, 20),
    "missing encoding": (meta(["encoding"]), ROWS, {7: 'missing "encoding" for column "geometry"'}, 20),
    "unknown encoding": (meta(encoding="bogus"), ROWS, {7: 'unsupported encoding "bogus" for column "geometry"', 17: 'invalid geometry in column "geometry": unsupported encoding: bogus'}, 17),
    "missing types": (meta(["geometry_types"]), ROWS, {8: 'missing "geometry_types" for column "geometry"'}, 20),
    "types of another type": (meta(geometry_types="Point"), ROWS, {8: 'expected "geometry_types" for column "geometry" to be a list, got "Point"'}, 20),
    "types not of strings": (meta(geometry_types=["Point", 1]), ROWS, {8: 'expected "geometry_types" for column "geometry" to be a list of strings, got ["Point",1]'}, 20),
    "unknown type": (meta(geometry_types=["Blob"]), ROWS, {8: 'unsupported geometry type "Blob" for column "geometry"', 18: 'unexpected geometry type "Point" for column "geometry"'}, 20),
    "crs of another type": (meta(crs="EPSG:4326"), ROWS, {9: 'expected "crs" for column "geometry" to be an object, got a string: "EPSG:4326"'}, 8),
    "no crs": (meta(crs=None), ROWS, {}, 20),
    "unknown orientation": (meta(orientation="clockwise"), ROWS, {10: 'unsupported orientation "clockwise" for column "geometry", expected "counterclockwise"', 19: 'unsupported orientation "clockwise" for column "geometry"'}, 20),
    "orientation of another type": (meta(orientation=1), ROWS, {10: 'expected "orientation" for column "geometry" to be a string, got a number: 1'}, 9),
    "unknown edges": (meta(edges="bent"), ROWS, {11: 'unsupported edges "bent" for column "geometry", expected "planar" or "spherical"'}, 20),
    "bbox of another type": (meta(bbox="x"), ROWS, {12: 'expected "bbox" for column "geometry" to be a list, got a string: "x"'}, 11),
    "bbox items of another type": (meta(bbox=[1, 2, 3, "4"]), ROWS, {12: 'expected "bbox" for column "geometry" to be a list of numbers, got [1,2,3,"4"]'}, 11),
    "bbox of another length": (meta(bbox=[1, 2, 3]), ROWS, {12: 'expected "bbox" for column "geometry" to be a list of 4 or 6 numbers, got [1,2,3]', 20: 'invalid bbox length for column "geometry"'}, 20),
    "epoch of another type": (meta(epoch="x"), ROWS, {13: 'expected "epoch" for column "geometry" to be a number, got a string: "x"'}, 12),
    "type not listed": (meta(geometry_types=["Polygon"]), ROWS, {18: 'unexpected geometry type "Point" for column "geometry"'}, 20),
    "type with z listed": (meta(geometry_types=["Point Z", "Polygon Z"]), ROWS, {}, 20),
    "exterior turns the wrong way": (meta(orientation="counterclockwise"), [poly(RING[::-1])], {19: 'invalid orientation for exterior ring in column "geometry"'}, 20),
    "interior turns the wrong way": (meta(orientation="counterclockwise"), [poly(RING, HOLE[::-1])], {19: 'invalid orientation for interior ring in column "geometry"'}, 20),
    "outside, east": (meta(bbox=[0, 0, 9, 10]), ROWS, {20: 'geometry in column "geometry" extends to 10.000000, east of the bbox'}, 20),
    "outside, of six numbers": (meta(bbox=[0, 1, 0, 10, 10, 0]), ROWS, {20: 'geometry in column "geometry" extends to 0.000000, south of the bbox'}, 20),
    "inside over the antimeridian": (meta(bbox=[170, -10, -170, 10]), [point(175, 0), point(-175, 1)], {}, 20),
    "outside over the antimeridian": (meta(bbox=[170, -10, -160, 10]), [point(175, 0), point(-155, 1)], {20: 'geometry in column "geometry" extends to -155.000000, outside of the bbox'}, 20),
    "empty geometry": (meta(bbox=[0, 0, 1, 1]), [b""], {}, 20),
    "no geometry in the bytes": (meta(**ALL), [point(5, 5), b"\x01\x01"], {17: 'invalid geometry in column "geometry": unexpected end of WKB'}, 17),
}


def file(path, metadata, rows, name="geometry"):
    values = [r if isinstance(r, bytes) or r is None else g.to_wkb(r) for r in rows]
    table = pa.table({name: pa.array(values, pa.binary()), "n": list(range(len(rows)))})
    pq.write_table(table.replace_schema_metadata({"geo": json.dumps(metadata)} if metadata is not None else {}), path)
    return str(path)


@pytest.mark.parametrize("name", CASES)
def test_report(spark, tmp_path, name):
    metadata, rows, failures, run = CASES[name]
    path = file(tmp_path / "x.parquet", metadata, rows)
    report = validate(spark, path)
    assert [c.title for c in report.checks] == TITLES
    assert {i: c.message for i, c in enumerate(report.checks, 1) if c.run and not c.passed} == failures
    assert sum(c.run for c in report.checks) == run
    assert report.valid is (not failures)
    short = validate(spark, path, metadata_only=True)
    assert len(short.checks) == METADATA_RULES
    assert {i: c.message for i, c in enumerate(short.checks, 1) if c.run and not c.passed} == {k: v for k, v in failures.items() if k <= METADATA_RULES}


def test_crs_shape(spark, tmp_path):
    path = file(tmp_path / "x.parquet", meta(crs={"type": "Sphere", "name": "x"}), ROWS)
    failed = [c for c in validate(spark, path).checks if not c.passed]
    assert len(failed) == 1 and failed[0].message.startswith("validation failed against https://proj.org/schemas/v0.6/projjson.schema.json: input is invalid: missing properties: 'source_crs', 'target_crs', 'transformation'")


def test_crs_kinds():
    from terravane.operators.projjson import problem

    axes = lambda *a: {"subtype": "ellipsoidal", "axis": [{"name": n, "abbreviation": n[:3], "direction": d, "unit": u} for n, d, u in a]}
    degrees = axes(("Geodetic latitude", "north", "degree"), ("Geodetic longitude", "east", "degree"))
    ensemble = {"name": "WGS 84 ensemble", "members": [{"name": "Transit", "id": {"authority": "EPSG", "code": 1166}}], "ellipsoid": DATUM["ellipsoid"], "accuracy": "2.0", "id": {"authority": "EPSG", "code": 6326}}
    world = {"type": "GeographicCRS", "name": "WGS 84", "datum_ensemble": ensemble, "coordinate_system": degrees, "scope": "all", "area": "World", "bbox": {"south_latitude": -90, "west_longitude": -180, "north_latitude": 90, "east_longitude": 180}, "id": {"authority": "EPSG", "code": 4326}}
    utm = {
        "type": "ProjectedCRS", "name": "UTM 31N", "base_crs": world, "coordinate_system": {"subtype": "Cartesian", "axis": [{"name": "Easting", "abbreviation": "E", "direction": "east", "unit": "metre"}]},
        "conversion": {"name": "UTM zone 31N", "method": {"name": "Transverse Mercator", "id": {"authority": "EPSG", "code": 9807}}, "parameters": [{"name": "Scale factor", "value": 0.9996, "unit": "unity"}]},
    }
    height = {"type": "VerticalCRS", "name": "h", "datum": {"type": "VerticalReferenceFrame", "name": "d"}, "coordinate_system": {"subtype": "vertical", "axis": [{"name": "h", "abbreviation": "H", "direction": "up", "unit": {"type": "LinearUnit", "name": "foot", "conversion_factor": 0.3048}}]}}
    shift = {"name": "s", "method": {"name": "m"}, "parameters": []}
    good = [world, utm, height, {"type": "CompoundCRS", "name": "c", "components": [utm, height]}, {"type": "BoundCRS", "source_crs": utm, "target_crs": world, "transformation": shift}, DATUM, {"type": "EngineeringCRS", "name": "e", "datum": {"name": "d"}}]
    assert [problem(g) for g in good] == [""] * len(good)
    bad = {
        "'datum', 'datum_ensemble'": {"type": "GeographicCRS", "name": "x"}, "missing properties: 'name'": {k: v for k, v in world.items() if k != "name"}, "'colour' not allowed": {**world, "colour": 1},
        "/name is invalid": {**world, "name": 1}, "/coordinate_system is invalid": {**world, "coordinate_system": {"subtype": "flat", "axis": []}}, "missing properties: 'base_crs', 'conversion', 'coordinate_system'": {"type": "ProjectedCRS", "name": "x"},
        "/base_crs is invalid": {**utm, "base_crs": height}, "/id is invalid": {**world, "id": {"authority": "EPSG"}}, "'source_crs', 'target_crs', 'transformation'": {"type": "BogusCRS"}, "both 'id' and 'ids'": {**world, "ids": []}, "/components is invalid": {"type": "CompoundCRS", "name": "c", "components": [{}]},
    }
    for message, document in bad.items():
        assert message in problem(document), (message, problem(document))


def test_no_key(spark, tmp_path):
    report = validate(spark, file(tmp_path / "x.parquet", None, ROWS))
    assert report.tally() == (0, 1, 19) and report.checks[0].message == 'missing "geo" metadata key'
    assert "19 checks not run" in report.to_text() and json.loads(report.to_json(False))["checks"][0]["run"] is True
    assert report.to_df(spark).where("run").count() == 1


def test_schema_rules(spark, tmp_path):
    path = str(tmp_path / "x.parquet")
    put = lambda **cols: pq.write_table(pa.table(cols).replace_schema_metadata({"geo": json.dumps(BASE)}), path)
    failed = lambda: {i: c.message for i, c in enumerate(validate(spark, path, True).checks, 1) if c.run and not c.passed}
    put(other=[1])
    assert failed() == {14: 'missing geometry column "geometry"'}
    put(geometry=[1])
    assert failed() == {15: 'unexpected type for column "geometry", got INT64'}
    put(geometry=[{"x": 1}])
    assert failed() == {14: 'column "geometry" must not be a group', 15: 'expected primitive column for "geometry"'}


def test_first_failure_is_by_row_over_files(spark, tmp_path):
    """Later files, rows and columns come later, however they are read."""
    folder = tmp_path / "many"
    folder.mkdir()
    metadata = meta(bbox=[0, 0, 10, 10])
    for k, x in enumerate((5, 20, 30)):
        file(folder / f"part-{k}.parquet", metadata, [point(5, 5)] * 3 + [point(x, 1)])
    assert validate(spark, str(folder)).checks[19].message == 'geometry in column "geometry" extends to 20.000000, east of the bbox'


def test_every_optional_rule_sees_every_column(spark, tmp_path):
    metadata = meta()
    metadata["columns"]["other"] = {"encoding": "WKB", "geometry_types": [], "edges": "bent"}
    path = tmp_path / "x.parquet"
    table = pa.table({"geometry": [g.to_wkb(point(1, 2))], "other": [g.to_wkb(point(3, 4))]})
    pq.write_table(table.replace_schema_metadata({"geo": json.dumps(metadata)}), path)
    assert [c.message for c in validate(spark, str(path)).checks if not c.passed] == ['unsupported edges "bent" for column "other", expected "planar" or "spherical"']
