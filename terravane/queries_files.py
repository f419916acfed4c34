"""Queries that write files with this library and read, describe, convert or validate them, with SQL
that gives the same rows from the tables alone."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from . import queries as q
from .errors import TerravaneError
from .functions.bbox import Bbox
from .metadata import KEY, GeoMetadata, crs_name
from .operators import describe as describing
from .operators import extract as extracting
from .operators import transform as transforming
from .operators import validate as validating
from .operators.convert import convert
from .plans import boxes
from .sources import footers, geojson, geoparquet, schema, storage

#: Rows in a row group of the files written here.
GROUP = 100
_made: dict[tuple, str] = {}


def _folder(spark: SparkSession) -> str:
    return f"{storage.shared_folder()}/queries-{uuid.uuid4().hex}"


def _kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[str], None], suffix: str = ".parquet") -> str:
    """A file that several queries read, written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        path = f"{_folder(spark)}/{name}{suffix}"
        where, at = storage.store(path)
        where.create_dir(at.rpartition("/")[0], recursive=True)
        make(path)
        _made[key] = path
    return _made[key]


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a box and a geometry, in order of their keys."""
    shapes = q._mixed(spark, sf_dir).select("c_custkey", "geometry")
    rows = q._boxed(q._read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").select("c_custkey", "c_name", "bbox")
    return geoparquet.with_metadata(rows.join(shapes, "c_custkey").orderBy("c_custkey"), q.META)


def _places(spark: SparkSession, sf_dir: str) -> str:
    return _kept(spark, sf_dir, "places", lambda at: geoparquet.write(_table(spark, sf_dir), at, row_group_length=GROUP, single_file=True))


def _with_metadata(spark: SparkSession, sf_dir: str, name: str, change: Callable[[dict], None], rows: Callable[[DataFrame], DataFrame] = lambda df: df) -> str:
    """The same rows with a changed geometry column entry."""
    meta = q.META.clone()
    change(meta.column("geometry"))
    return _kept(spark, sf_dir, name, lambda at: geoparquet.write(rows(_table(spark, sf_dir)), at, meta, single_file=True))


_SHAPE = f"CASE kind WHEN 'Point' THEN {q._SHAPE_SQL['point']} WHEN 'LineString' THEN {q._SHAPE_SQL['line']} ELSE {q._SHAPE_SQL['polygon']} END"
#: Rows of the file, with their number; wx is the box's east end, over the antimeridian west.
_FILE = f"""WITH src AS (SELECT c_custkey AS k, c_custkey, c_name FROM customer), placed AS (SELECT *, {q._PLACED} FROM src),
file AS (SELECT *, row_number() OVER (ORDER BY c_custkey)-1 AS rn, lon::DOUBLE AS xmin, lat::DOUBLE AS ymin, (CASE WHEN lon+w>180 THEN lon+w-360 ELSE lon+w END)::DOUBLE AS xmax, (lat+w)::DOUBLE AS ymax,
CASE c_custkey%3 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' ELSE 'Polygon' END AS kind FROM placed),
shaped AS (SELECT *, ({_SHAPE}) AS wkt, (CASE WHEN kind='Point' THEN lon ELSE lon+w END)::DOUBLE AS gx, (CASE WHEN kind='Point' THEN lat ELSE lat+w END)::DOUBLE AS gy FROM file)"""


def file_scan(spark, sf_dir):
    """Written and read whole: every column, the geometry's bytes, the box."""
    df = geoparquet.read(spark, _places(spark, sf_dir))
    return df.select("c_custkey", "c_name", F.hex("geometry").alias("wkb"), "bbox.xmin", "bbox.ymin", "bbox.xmax", "bbox.ymax")


def file_columns(spark, sf_dir):
    return geoparquet.read(spark, _places(spark, sf_dir), columns=["geometry", "c_name", "no_such"]).select("c_name", F.hex("geometry").alias("wkb"))


def file_row_groups(spark, sf_dir):
    return geoparquet.read(spark, _places(spark, sf_dir), row_groups=[0, 2]).select("c_custkey")


def _parts(spark, sf_dir) -> str:
    """Three files of one name, in folders k=0 to 2, with row groups of different lengths."""

    def make(at: str) -> None:
        df = _table(spark, sf_dir)
        for k in range(3):
            storage.store(at)[0].create_dir(f"{storage.store(at)[1]}/k={k}", recursive=True)
            geoparquet.write(df.where(F.col("c_custkey") % 3 == k).orderBy("c_custkey"), f"{at}/k={k}/part-0.parquet", row_group_length=20 + 10 * k, single_file=True)

    return _kept(spark, sf_dir, "parts", make, "")


def file_row_groups_of_folders(spark, sf_dir):
    return geoparquet.read(spark, _parts(spark, sf_dir), row_groups=[1]).select("c_custkey", F.col("k").cast("int").alias("k"))


def file_row_group_stats(spark, sf_dir):
    return geoparquet.row_group_stats(spark, _places(spark, sf_dir), "bbox.xmin").select("row_group", "first", "rows", "min", "max")


def file_row_group_boxes(spark, sf_dir):
    found = boxes.row_group_boxes(spark, _places(spark, sf_dir))
    return found.select("row_group", F.col("low_xmin").alias("xmin"), F.col("low_ymin").alias("ymin"), F.col("high_xmax").alias("xmax"), F.col("high_ymax").alias("ymax"))


SMALL = Bbox(40, -89, 60, -40)


def file_row_groups_meeting(spark, sf_dir):
    return boxes.row_groups_meeting(spark, _places(spark, sf_dir), SMALL).select("row_group", "rows")


def file_extract(spark, sf_dir):
    """Row groups by statistics, then rows by their boxes, then columns."""
    df = boxes.extract_row_groups(spark, _places(spark, sf_dir), SMALL)
    return extracting.extract(df, SMALL, keep=["c_custkey", "c_name", "geometry"]).drop("geometry")


def file_extract_written(spark, sf_dir):
    """Extracted rows in a file of their own, read again."""
    at = f"{_folder(spark)}/out"
    geoparquet.write(extracting.extract(geoparquet.read(spark, _places(spark, sf_dir)), q.QUERY, drop=["c_name"]), at, compression="gzip")
    return geoparquet.read(spark, at).select("c_custkey", F.hex("geometry").alias("wkb"))


def file_describe(spark, sf_dir):
    return describing.describe(spark, _places(spark, sf_dir)).withColumns({c: F.coalesce(c, F.lit("")) for c in ("type", "annotation", "compression")})


def file_counts(spark, sf_dir):
    one, many = (describing.info(p, spark) for p in (_places(spark, sf_dir), _parts(spark, sf_dir)))
    return spark.createDataFrame([(n, f["rows"], f["groups"], len(f["issues"]), f["metadata"]["primary_column"]) for n, f in (("file", one), ("folder", many))], "what string, n_rows long, n_groups long, issues long, primary_column string")


def _codecs(spark, path: str) -> DataFrame:
    return spark.createDataFrame(sorted(geoparquet.column_codecs(path).items()), "leaf string, codec string")


def file_codecs(spark, sf_dir):
    """Each codec that Spark's readers know, written and read again."""
    out = []
    df = _table(spark, sf_dir).select("c_custkey", "geometry").persist(StorageLevel.MEMORY_AND_DISK)  # made once for all codecs
    for name in (c for c in geoparquet.CODECS if c != "brotli"):
        at = f"{_folder(spark)}/{name}.parquet"
        geoparquet.write(df, at, compression=name)
        out.append(_codecs(spark, at).where("leaf = 'geometry'").crossJoin(geoparquet.read(spark, at).agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("total"))))
    df.unpersist()
    made = out[0]
    for o in out[1:]:
        made = made.unionByName(o)
    return made.select("codec", "n", "total")


def convert_keeps_codecs(spark, sf_dir):
    """Columns with codecs of their own keep them where none is asked for."""
    source = _kept(spark, sf_dir, "codecs", lambda at: geoparquet.write(_table(spark, sf_dir).drop("bbox"), at, compression="snappy", codecs={"c_custkey": "gzip", "c_name": "snappy", "geometry": "zstd"}, single_file=True))
    at = f"{_folder(spark)}/kept.parquet"
    convert(spark, source, at, single_file=True)
    return _codecs(spark, at)


def _text_table(spark, sf_dir) -> str:
    """Plain Parquet with WKT."""
    df = q._mixed(spark, sf_dir).select("c_custkey", F.col("wkt").alias("geometry"))
    return _kept(spark, sf_dir, "text", lambda at: df.write.parquet(at))


def convert_text_rows(spark, sf_dir):
    at = f"{_folder(spark)}/out.parquet"
    convert(spark, _text_table(spark, sf_dir), at)
    return geoparquet.read(spark, at).select("c_custkey", F.hex("geometry").alias("wkb"))


def _document(spark, path: str) -> DataFrame:
    meta = geoparquet.file_metadata(path)
    own = meta.columns["geometry"]
    row = (meta.version, meta.primary_column, own["encoding"], ",".join(sorted(own["geometry_types"])), *map(float, own["bbox"]))
    return spark.createDataFrame([row], "version string, primary_column string, encoding string, types string, xmin double, ymin double, xmax double, ymax double")


def convert_text_metadata(spark, sf_dir):
    """The document of a converted file: bounds and types summed from the rows."""
    at = f"{_folder(spark)}/out.parquet"
    convert(spark, _text_table(spark, sf_dir), at)
    return _document(spark, at)


def convert_bytes_metadata(spark, sf_dir):
    """Geometry in bytes, under another name, with statistics asked for."""
    source = _kept(spark, sf_dir, "bytes", lambda at: q._mixed(spark, sf_dir).select("c_custkey", F.col("geometry").alias("shape")).write.parquet(at))
    at = f"{_folder(spark)}/out.parquet"
    made = convert(spark, source, at, primary="shape", compute_stats=True)
    own = geoparquet.file_metadata(at).columns["shape"]
    return spark.createDataFrame([(made["records"], made["geo"]["primary_column"], ",".join(sorted(own["geometry_types"])), float(own["bbox"][0]))], "records long, primary_column string, types string, xmin double")


def _lines(spark, sf_dir) -> str:
    df = _table(spark, sf_dir).drop("bbox")
    return _kept(spark, sf_dir, "lines", lambda at: geojson.write(df, at), "")


def _collection(spark, sf_dir) -> str:
    df = _table(spark, sf_dir).drop("bbox")
    return _kept(spark, sf_dir, "collection", lambda at: geojson.write(df, at, single_file=True), ".geojson")


def _read_features(df: DataFrame) -> DataFrame:
    return df.select("c_custkey", "c_name", F.hex("geometry").alias("wkb"))


def geojson_lines(spark, sf_dir):
    return _read_features(geojson.read(spark, _lines(spark, sf_dir), lines=True))


def geojson_collection(spark, sf_dir):
    return _read_features(geojson.read(spark, _collection(spark, sf_dir)))


def geojson_schema(spark, sf_dir):
    """Columns that inference finds: in order of their names, numbers as doubles."""
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(geojson.read(spark, _collection(spark, sf_dir)).dtypes)], "place int, name string, type string")


def geojson_ids(spark, sf_dir):
    """Ids written as members of their features and read again."""
    df = geoparquet.with_metadata(_table(spark, sf_dir).select("c_custkey", F.concat(F.lit("c-"), "c_custkey").alias("name"), "geometry"), q.META)
    at = f"{_folder(spark)}/ids"
    geojson.write(df, at, id_column="name")
    return geojson.read(spark, at, lines=True, keep_id=True).select(F.col("c_custkey").cast("long").alias("c_custkey"), F.get_json_object(F.concat(F.lit('{"id":'), "id", F.lit("}")), "$.id").alias("id"))


def geojson_pending(spark, sf_dir):
    """A property that's null at first takes the type of its first value."""
    keys = q._read(spark, sf_dir, "customer").select("c_custkey").orderBy("c_custkey").coalesce(1)
    text = F.concat(F.lit('{"type":"Feature","geometry":null,"properties":{"k":'), "c_custkey", F.lit(',"late":'), F.when(F.col("c_custkey") > 20, F.concat(F.lit('{"n":'), "c_custkey", F.lit("}"))).otherwise(F.lit("null")), F.lit("}}"))
    at = f"{_folder(spark)}/pending.ndgeojson"
    keys.select(text.alias("value")).write.text(at)
    df = geojson.read(spark, at)
    return df.select(F.col("k").cast("long").alias("k"), F.col("late.n").alias("n"), F.col("geometry").isNull().alias("empty"))


def convert_geojson_rows(spark, sf_dir):
    at = f"{_folder(spark)}/out.parquet"
    convert(spark, _collection(spark, sf_dir), at, row_group_length=GROUP)
    return _read_features(geoparquet.read(spark, at))


def convert_geojson_metadata(spark, sf_dir):
    at = f"{_folder(spark)}/out.parquet"
    convert(spark, _collection(spark, sf_dir), at, single_file=True)
    return _document(spark, at)


def convert_to_geojson(spark, sf_dir):
    at = f"{_folder(spark)}/out.geojson"
    convert(spark, _places(spark, sf_dir), at, single_file=True)
    return geojson.read(spark, at).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", q.columns.geometry_type("geometry").alias("kind"), F.col("bbox.xmax").alias("xmax"))


def wkt_output(spark, sf_dir):
    """Geometry written as text, with the entry saying so."""
    at = f"{_folder(spark)}/out"
    geoparquet.write(_table(spark, sf_dir), at, encoding="WKT")
    return geoparquet.read(spark, at).select("c_custkey", F.col("geometry").alias("text"), F.lit(geoparquet.file_metadata(at).columns["geometry"]["encoding"]).alias("encoding"))


def transform_columns(spark, sf_dir):
    """Text to numbers and a new name, in row groups of another length."""
    source = _kept(spark, sf_dir, "numbers", lambda at: q._read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("string").alias("balance")).write.parquet(at))
    at = f"{_folder(spark)}/out.parquet"
    wanted = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("amount", T.DoubleType())])
    transforming.transform(spark, source, at, {"balance": transforming.text_to_number, "c_custkey": lambda c: c.cast("long")}, wanted, row_group_length=50)
    return spark.read.parquet(at)


def schema_message(spark, sf_dir):
    lines = schema.message(storage.open_parquet(_places(spark, sf_dir)).schema).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "place int, line string")


def schema_lookup(spark, sf_dir):
    root = schema.tree(storage.open_parquet(_places(spark, sf_dir)).schema)
    found = {p: schema.leaf(root, p) for p in ("bbox.xmin", "geometry", "bbox", "bbox.no", "no")}
    return spark.createDataFrame([(p, n is not None, n.physical if n else "", n.repetition if n else "") for p, n in found.items()], "path string, found boolean, physical string, repetition string")


FORMATS = ["a.parquet", "a.pq", "a.geoparquet", "a.geojson", "a.json", "a.ndjson", "a.geojsonl", "a.ndgeojson", "a.csv", "a", "a.PARQUET", "http://x/y.geojson?z=1.pq", "a.gparquet"]


def formats(spark, sf_dir):
    return spark.createDataFrame([(n, storage.format_of(n).value) for n in FORMATS], "name string, format string")


def box_texts(spark, sf_dir):
    """Query boxes from text, made of keys."""
    keys = [r.c_custkey for r in q._read(spark, sf_dir, "customer").select("c_custkey").where("c_custkey <= 50").collect()]
    rows = [(k, b.xmin, b.ymin, b.shifted().xmin, b.xmax) for k in keys for b in [Bbox.parse(f"{k},-{k}.5,{-k if k % 2 else k + 1},1e1")]]
    return spark.createDataFrame(rows, "k long, xmin double, ymin double, shifted double, xmax double")


def validate_file(spark, sf_dir):
    """All twenty rules of a file that keeps them."""
    report = validating.validate(spark, _with_metadata(spark, sf_dir, "good", lambda c: c.update(geometry_types=["Point", "LineString", "Polygon"], orientation="counterclockwise", edges="planar", epoch=2020.5, bbox=[-180, -90, 187, 97], crs=None)))
    return report.to_df(spark)


def validate_folder(spark, sf_dir):
    """The first row that fails, over several files of one name."""
    at = _parts(spark, sf_dir)
    good = validating.validate(spark, at)
    return good.to_df(spark).groupBy("run", "passed").agg(F.count(F.lit(1)).alias("n"))


def _data_rule(name: str, change: Callable[[dict], None], rows: Callable[[DataFrame], DataFrame] = lambda df: df):
    def query(spark, sf_dir):
        report = validating.validate(spark, _with_metadata(spark, sf_dir, name, change, rows))
        return report.to_df(spark).where("ord > 16").select("ord", "run", "passed", "message")

    return query


def _turned(df: DataFrame) -> DataFrame:
    """Some polygons run clockwise."""
    placed = q._place(df.select("c_custkey"), "c_custkey")
    lon, lat, w = (F.col(c).cast("long") for c in ("lon", "lat", "w"))
    back = F.format_string("POLYGON((%d %d,%d %d,%d %d,%d %d))", lon, lat, lon, lat + w, lon + w, lat + w, lon, lat)
    made = placed.select("c_custkey", q.columns.wkt_to_wkb(back).alias("back"))
    return df.join(made, "c_custkey").withColumn("geometry", F.when(F.col("c_custkey") % 4 == 0, F.col("back")).otherwise(F.col("geometry"))).drop("back").orderBy("c_custkey")


def _cut(df: DataFrame) -> DataFrame:
    """Some values end early."""
    return df.withColumn("geometry", F.when(F.col("c_custkey") % 11 == 5, F.expr("substring(geometry, 1, 3)")).otherwise(F.col("geometry")))


def _outcomes(failing: dict[int, str], unrun: tuple[int, ...] = ()) -> str:
    """SQL of rules 17 to 20; `failing` gives the SQL of their messages, null where all rows pass."""
    rows = [f"SELECT {i} AS ord, {i not in unrun} AS run, {f'({failing[i]}) IS NULL' if i in failing else i not in unrun} AS passed, coalesce(({failing.get(i, 'NULL')}), '') AS message" for i in range(17, 21)]
    return " UNION ALL ".join(rows)


def _bounds_sql(limits: list[float]) -> str:
    x0, y0, x1, y1 = limits
    if x0 <= x1:
        cases = f"WHEN xmin<{x0} THEN format('{{:.6f}}, west', xmin) WHEN gx>{x1} THEN format('{{:.6f}}, east', gx)"
    else:
        cases = f"WHEN gx>{x1} AND gx<{x0} THEN format('{{:.6f}}, outside', gx) WHEN xmin<{x0} AND xmin>{x1} THEN format('{{:.6f}}, outside', xmin)"
    cases += f" WHEN ymin<{y0} THEN format('{{:.6f}}, south', ymin) WHEN gy>{y1} THEN format('{{:.6f}}, north', gy)"
    return f"SELECT 'geometry in column \"geometry\" extends to ' || arg_min(o, rn) FILTER (o IS NOT NULL) || ' of the bbox' FROM (SELECT rn, CASE {cases} END AS o FROM shaped)"


#: Documents that break one rule each: how, which rule, its message, and whether the run ends there.
_GOOD_COLUMN = {"encoding": "WKB", "geometry_types": []}


def _broken() -> list[tuple[str, object, int, str, bool]]:
    def doc(**change):
        return {k: v for k, v in {"version": "1.0.0", "primary_column": "geometry", "columns": {"geometry": _GOOD_COLUMN}, **change}.items() if v is not ...}

    def column(**change):
        return doc(columns={"geometry": {k: v for k, v in {**_GOOD_COLUMN, **change}.items() if v is not ...}})

    return [
        ("no key", ..., 1, 'missing "geo" metadata key', True),
        ("a list", [1], 2, "failed to parse file metadata as a JSON object", True),
        ("no version", doc(version=...), 3, 'missing "version" in metadata', False),
        ("version 1", doc(version=1), 3, 'expected "version" to be a string, got 1', False),
        ("empty version", doc(version=""), 3, 'expected "version" to be a non-empty string', False),
        ("no primary", doc(primary_column=...), 4, 'missing "primary_column" in metadata', False),
        ("primary true", doc(primary_column=True), 4, 'expected "primary_column" to be a string, got true', False),
        ("no columns", doc(columns=...), 5, 'missing "columns" in metadata', True),
        ("columns text", doc(columns="x"), 5, 'expected "columns" to be an object, got "x"', True),
        ("column text", doc(columns={"geometry": "x"}), 5, 'expected column "geometry" to be an object, got "x"', True),
        ("other primary", doc(primary_column="other"), 6, 'the "other" column is not included in the column metadata', False),
        ("no encoding", column(encoding=...), 7, 'missing "encoding" for column "geometry"', False),
        ("encoding TWKB", column(encoding="TWKB"), 7, 'unsupported encoding "TWKB" for column "geometry"', False),
        ("no types", column(geometry_types=...), 8, 'missing "geometry_types" for column "geometry"', False),
        ("types text", column(geometry_types="Point"), 8, 'expected "geometry_types" for column "geometry" to be a list, got "Point"', False),
        ("type Circle", column(geometry_types=["Circle"]), 8, 'unsupported geometry type "Circle" for column "geometry"', False),
        ("crs text", column(crs="x"), 9, 'expected "crs" for column "geometry" to be an object, got a string: "x"', True),
        ("bogus crs", column(crs={"type": "BogusCRS"}), 9, "validation failed against https://proj.org/schemas/v0.6/projjson.schema.json: input is invalid: missing properties: 'source_crs', 'target_crs', 'transformation'", False),
        ("orientation 1", column(orientation=1), 10, 'expected "orientation" for column "geometry" to be a string, got a number: 1', True),
        ("clockwise", column(orientation="clockwise"), 10, 'unsupported orientation "clockwise" for column "geometry", expected "counterclockwise"', False),
        ("edges", column(edges="round"), 11, 'unsupported edges "round" for column "geometry", expected "planar" or "spherical"', False),
        ("bbox of 3", column(bbox=[1, 2, 3]), 12, 'expected "bbox" for column "geometry" to be a list of 4 or 6 numbers, got [1,2,3]', False),
        ("bbox text", column(bbox=[1, 2, 3, "4"]), 12, 'expected "bbox" for column "geometry" to be a list of numbers, got [1,2,3,"4"]', True),
        ("epoch text", column(epoch="x"), 13, 'expected "epoch" for column "geometry" to be a number, got a string: "x"', True),
        ("grouped", doc(primary_column="bbox", columns={"bbox": _GOOD_COLUMN}), 14, 'column "bbox" must not be a group', True),
        ("stored", doc(primary_column="c_custkey", columns={"c_custkey": _GOOD_COLUMN}), 15, 'unexpected type for column "c_custkey", got INT32', True),
    ]


def validate_documents(spark, sf_dir):
    """Metadata rules on documents that break one each: the first rule that fails."""
    root = schema.tree(storage.open_parquet(_places(spark, sf_dir)).schema)
    key_type = schema.leaf(root, "c_custkey").physical.upper()
    out = []
    for name, document, *_ in _broken():
        pairs = [] if document is ... else [(KEY, json.dumps(document))]
        report = validating.report(pairs, root, None)
        at = next(i for i, c in enumerate(report.checks, 1) if c.run and not c.passed)
        passed, failed, unrun = report.tally()
        out.append((name, at, report.checks[at - 1].message.replace(key_type, "INT32"), unrun > 0))
    return spark.createDataFrame(out, "document string, rule int, message string, ended boolean")


def validate_summary(spark, sf_dir):
    """The tally of a run that ends early."""
    report = validating.validate(spark, _with_metadata(spark, sf_dir, "cut", lambda c: None, _cut))
    passed, failed, unrun = report.tally()
    return spark.createDataFrame([(passed, failed, unrun, report.valid)], "passed long, failed long, unrun long, valid boolean")


def report_text(spark, sf_dir):
    """The report for people, line by line."""
    report = validating.validate(spark, _with_metadata(spark, sf_dir, "cut", lambda c: None, _cut))
    lines = [x.split(": ")[0] for x in report.to_text().split("\n") if x.strip()]
    return spark.createDataFrame(list(enumerate(lines)), "place int, line string")


JSON_VALUES = ["null", "true", "1", "1.0", "2.5", '"a<b&c"', "[1,[2,null]]", '{"b":1,"a":{"d":[],"c":false}}']


def json_texts(spark, sf_dir):
    """Values as they stand in messages, and the names of their types."""
    return spark.createDataFrame([(v, validating.as_json(json.loads(v)), validating.json_type(json.loads(v))) for v in JSON_VALUES], "value string, text string, type string")


CRS = ['{"name":"WGS 84"}', '{"id":{"authority":"OGC","code":"CRS84"}}', '{"id":{"authority":"EPSG","code":4326}}', '{"name":"","id":{"authority":"A","code":"B"}}', "{}", "null"]


def crs_names(spark, sf_dir):
    return spark.createDataFrame([(c, crs_name(json.loads(c))) for c in CRS], "crs string, name string")


def column_errors(spark, sf_dir):
    """What a choice of columns that can't be had says."""
    df = geoparquet.read(spark, _places(spark, sf_dir))
    asked = {
        "both": lambda: extracting.extract(df, keep=["geometry"], drop=["bbox"]),
        "kept": lambda: extracting.extract(df, keep=["c_name"]),
        "dropped": lambda: extracting.extract(df, drop=["geometry"]),
        "read": lambda: geoparquet.read(spark, _places(spark, sf_dir), columns=["c_name"]),
        "box": lambda: extracting.extract(df, "1,2,3"),
        "number": lambda: extracting.extract(df, "1,2,x,4"),
    }
    out = []
    for name, ask in asked.items():
        try:
            ask()
        except TerravaneError as e:
            out.append((name, str(e)))
    return spark.createDataFrame(out, "what string, message string")


def metadata_edits(spark, sf_dir):
    """Defaults, clones, narrowed documents and the older name of the types."""
    plain = GeoMetadata.default("shape")
    changed = plain.clone()
    changed.column("other")["geometry_type"] = "Point"
    rows = [("default", plain.to_json()), ("clone", changed.to_json()), ("only", changed.only(["other"]).to_json()), ("types", json.dumps(changed.geometry_types("other")))]
    return spark.createDataFrame(rows, "what string, document string")


def file_footer(spark, sf_dir):
    """The pairs of a footer, as they stand."""
    found = [(k, GeoMetadata.parse(v).primary_column if k == KEY else "") for k, v in footers.pairs(_places(spark, sf_dir)) if not k.startswith("ARROW")]
    return spark.createDataFrame(found, "key string, primary_column string")


PATHS = ["/a/b", "a b.parquet", "s3://b/k", "s3a://b/k", "gs://b/k", "hdfs://h/k", "azblob://c/a/k?storage_account=x", "ftp://h/k"]


def schemes(spark, sf_dir):
    """What Spark reads a path by."""
    out = []
    for p in PATHS:
        try:
            out.append((p, storage.readable(p)))
        except TerravaneError as e:
            out.append((p, str(e)))
    return spark.createDataFrame(out, "path string, read_by string")


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    one = lambda v: "NULL" if v is None else _text(v) if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({names})"


_READ_SQL = f"{_FILE} SELECT c_custkey, hex(ST_AsWKB(wkt::GEOMETRY)) AS wkb FROM shaped"
_FEATURES_SQL = f"{_FILE} SELECT c_custkey::DOUBLE AS c_custkey, c_name, hex(ST_AsWKB(wkt::GEOMETRY)) AS wkb FROM shaped"
_DOCUMENT_SQL = f"{_FILE} SELECT '1.0.0' AS version, 'geometry' AS primary_column, 'WKB' AS encoding, string_agg(DISTINCT kind, ',' ORDER BY kind) AS types, min(xmin) AS xmin, min(ymin) AS ymin, max(gx) AS xmax, max(gy) AS ymax FROM shaped"
_MEET = "ymax >= {b.ymin} AND ymin <= {b.ymax} AND xmax >= {b.xmin} AND {x} <= {b.xmax}"
_GOOD_TYPES = ["Point", "LineString", "Polygon"]
_GROUPS = f"{_FILE}, groups AS (SELECT (rn//{GROUP})::INT AS row_group, min(rn) AS first, count(*) AS rows, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, max(xmin) AS x_high, min(xmax) AS x_low FROM file GROUP BY 1)"
_BOUNDS, _OVER = [-100.0, -60.0, 100.0, 60.0], [100.0, -80.0, -100.0, 80.0]
_NODES = [
    ("c_custkey", "c_custkey", 0, True, False, "int64", "", "zstd"), ("c_name", "c_name", 0, True, False, "binary", "string", "zstd"), ("bbox", "bbox", 0, False, False, "", "group", ""),
    *[(f"bbox.{f}", f, 1, True, False, "double", "", "zstd") for f in boxes.FIELDS], ("geometry", "geometry", 0, True, False, "binary", "", "zstd"),
]
_PLAIN = [
    file_scan, file_columns, file_row_groups, file_row_groups_of_folders, file_row_group_stats, file_row_group_boxes, file_row_groups_meeting, file_extract, file_extract_written, file_describe, file_counts,
    file_codecs, convert_keeps_codecs, convert_text_rows, convert_text_metadata, convert_bytes_metadata, geojson_lines, geojson_collection, geojson_schema, geojson_ids, geojson_pending, convert_geojson_rows,
    convert_geojson_metadata, convert_to_geojson, wkt_output, transform_columns, schema_message, schema_lookup, formats, box_texts, validate_file, validate_folder, validate_documents, validate_summary,
    report_text, json_texts, crs_names, column_errors, metadata_edits, file_footer, schemes,
]
_MESSAGE = ["message {", "  optional int64 c_custkey;", "  optional binary c_name (STRING);", "  required group bbox {", *(f"    optional double {f};" for f in boxes.FIELDS), "  }", "  optional binary geometry;", "}", ""]
_SQL = {
    "file_scan": f"{_FILE} SELECT c_custkey, c_name, hex(ST_AsWKB(wkt::GEOMETRY)) AS wkb, xmin, ymin, xmax, ymax FROM shaped",
    "file_columns": f"{_FILE} SELECT c_name, hex(ST_AsWKB(wkt::GEOMETRY)) AS wkb FROM shaped",
    "file_row_groups": f"{_FILE} SELECT c_custkey FROM file WHERE rn//{GROUP} IN (0, 2)",
    "file_row_groups_of_folders": "SELECT c_custkey, k FROM (SELECT c_custkey, (c_custkey%3)::INT AS k, row_number() OVER (PARTITION BY c_custkey%3 ORDER BY c_custkey)-1 AS rn FROM customer) WHERE rn//(20+10*k) = 1",
    "file_row_group_stats": f"{_FILE} SELECT (rn//{GROUP})::INT AS row_group, min(rn) AS first, count(*) AS rows, min(xmin) AS min, max(xmin) AS max FROM file GROUP BY 1",
    "file_row_group_boxes": f"{_GROUPS} SELECT row_group, xmin, ymin, xmax, ymax FROM groups",
    "file_row_groups_meeting": f"{_GROUPS} SELECT row_group, rows FROM groups WHERE ymax >= {SMALL.ymin} AND ymin <= {SMALL.ymax} AND xmax >= {SMALL.xmin} AND (xmin <= {SMALL.xmax} OR (x_high > 0 AND x_low < 0))",
    "file_extract": f"{_FILE} SELECT c_custkey, c_name FROM file WHERE {q._hit(SMALL)}",
    "file_extract_written": f"{_FILE} SELECT c_custkey, hex(ST_AsWKB(wkt::GEOMETRY)) AS wkb FROM shaped WHERE {q._hit(q.QUERY)}",
    "file_describe": _values(_NODES, "path, name, depth, optional, repeated, type, annotation, compression"),
    "file_counts": f"SELECT 'file' AS what, count(*) AS n_rows, ceil(count(*)/{GROUP}.0)::BIGINT AS n_groups, 0::BIGINT AS issues, 'geometry' AS primary_column FROM customer UNION ALL SELECT 'folder', sum(n)::BIGINT, sum(ceil(n/(20.0+10*k)))::BIGINT, 0, 'geometry' FROM (SELECT c_custkey%3 AS k, count(*) AS n FROM customer GROUP BY 1)",
    "file_codecs": "SELECT unnest(['uncompressed','snappy','gzip','zstd','lz4']) AS codec, n, total FROM (SELECT count(*) AS n, sum(c_custkey)::BIGINT AS total FROM customer)",
    "convert_keeps_codecs": _values([("c_custkey", "gzip"), ("c_name", "snappy"), ("geometry", "zstd")], "leaf, codec"),
    "convert_text_rows": _READ_SQL,
    "convert_text_metadata": _DOCUMENT_SQL,
    "convert_bytes_metadata": f"{_FILE} SELECT count(*) AS records, 'shape' AS primary_column, string_agg(DISTINCT kind, ',' ORDER BY kind) AS types, min(xmin) AS xmin FROM shaped",
    "geojson_lines": _FEATURES_SQL,
    "geojson_collection": _FEATURES_SQL,
    "geojson_schema": _values([(0, "c_custkey", "double"), (1, "c_name", "string"), (2, "geometry", "binary")], "place, name, type"),
    "geojson_ids": "SELECT c_custkey, 'c-' || c_custkey AS id FROM customer",
    "geojson_pending": "SELECT c_custkey AS k, CASE WHEN c_custkey > 20 THEN c_custkey::DOUBLE END AS n, true AS empty FROM customer",
    "convert_geojson_rows": _FEATURES_SQL,
    "convert_geojson_metadata": _DOCUMENT_SQL,
    "convert_to_geojson": f"{_FILE} SELECT c_custkey, c_name, kind, xmax FROM shaped",
    "wkt_output": f"{_FILE} SELECT c_custkey, replace(replace(ST_AsText(wkt::GEOMETRY), ' (', '('), ', ', ',') AS text, 'WKT' AS encoding FROM shaped",
    "transform_columns": "SELECT c_custkey::BIGINT AS c_custkey, c_acctbal::DOUBLE AS amount FROM customer",
    "schema_message": _values(list(enumerate(_MESSAGE)), "place, line"),
    "schema_lookup": _values([("bbox.xmin", True, "double", "optional"), ("geometry", True, "binary", "optional"), ("bbox", True, "", "required"), ("bbox.no", False, "", ""), ("no", False, "", "")], "path, found, physical, repetition"),
    "formats": _values(list(zip(FORMATS, ["parquet", "parquet", "geoparquet", "geojson", "geojson", "geojson", "geojson", "geojson", "", "", "", "geojson", ""])), "name, format"),
    "box_texts": "SELECT k, k::DOUBLE AS xmin, -(k+0.5)::DOUBLE AS ymin, (CASE WHEN k%2=1 THEN k-360 ELSE k END)::DOUBLE AS shifted, (CASE WHEN k%2=1 THEN -k ELSE k+1 END)::DOUBLE AS xmax FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey <= 50)",
    "validate_file": _values([(i, t, True, True, "") for i, t in enumerate(validating.TITLES, 1)], "ord, title, run, passed, message"),
    "validate_folder": "SELECT true AS run, true AS passed, 20::BIGINT AS n",
    "validate_documents": _values([(n, rule, message, over) for n, _, rule, message, over in _broken()], "document, rule, message, ended"),
    "report_text": _values(list(enumerate(["Summary", *(f" ✓ {t}" for t in validating.TITLES[:16]), f" ✗ {validating.TITLES[16]}", '   ↳ invalid geometry in column "geometry"', *(x for t in validating.TITLES[17:] for x in (f" ! {t}", "   ↳ not checked"))])), "place, line"),
    "json_texts": _values(list(zip(JSON_VALUES, ["null", "true", "1", "1", "2.5", '"a\\u003cb\\u0026c"', "[1,[2,null]]", '{"a":{"c":false,"d":[]},"b":1}'], ["<nil>", "boolean", "number", "number", "number", "string", "list", "object"])), "value, text, type"),
    "crs_names": _values(list(zip(CRS, ["WGS 84", "OGC:CRS84", "EPSG:4326", "A:B", "Unknown", "Unknown"])), "crs, name"),
    "column_errors": _values([
        ("both", "please pass either columns to keep or columns to drop, not both"), *((n, 'columns must include the primary geometry column "geometry"') for n in ("kept", "dropped", "read")),
        ("box", "please provide 4 comma-separated values (xmin,ymin,xmax,ymax) as a bbox"), ("number", "trouble parsing xmax input as float64: 'x'"),
    ], "what, message"),
    "metadata_edits": _values([
        ("default", '{"version":"1.0.0","primary_column":"shape","columns":{"shape":{"encoding":"WKB","geometry_types":[]}}}'),
        ("clone", '{"version":"1.0.0","primary_column":"shape","columns":{"shape":{"encoding":"WKB","geometry_types":[]},"other":{"encoding":"WKB","geometry_types":[],"geometry_type":"Point"}}}'),
        ("only", '{"version":"1.0.0","primary_column":"shape","columns":{"other":{"encoding":"WKB","geometry_types":[],"geometry_type":"Point"}}}'), ("types", "[]"),
    ], "what, document"),
    "file_footer": "SELECT 'geo' AS key, 'geometry' AS primary_column",
    "schemes": _values(list(zip(PATHS, ["/a/b", "a b.parquet", "s3a://b/k", "s3a://b/k", "gs://b/k", "hdfs://h/k", "abfss://c@x.dfs.core.windows.net/a/k", "unsupported scheme 'ftp' in 'ftp://h/k'"])), "path, read_by"),
    "validate_summary": "SELECT 16::BIGINT AS passed, 1::BIGINT AS failed, 3::BIGINT AS unrun, false AS valid",
}
_PAIRS = {
    "validate_types": (_data_rule("types", lambda c: c.update(geometry_types=["Point", "Polygon"])), {18: "SELECT 'unexpected geometry type \"' || arg_min(kind, rn) || '\" for column \"geometry\"' FROM shaped WHERE kind='LineString'"}),
    "validate_orientation": (_data_rule("turned", lambda c: c.update(orientation="counterclockwise"), _turned), {19: "SELECT CASE WHEN count(*) > 0 THEN 'invalid orientation for exterior ring in column \"geometry\"' END FROM shaped WHERE c_custkey%4=0"}),
    "validate_bounds": (_data_rule("bounds", lambda c: c.update(bbox=_BOUNDS)), {20: _bounds_sql(_BOUNDS)}),
    "validate_bounds_antimeridian": (_data_rule("bounds-over", lambda c: c.update(bbox=_OVER)), {20: _bounds_sql(_OVER)}),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _PLAIN} | {k: query for k, (query, _) in _PAIRS.items()}


def oracle_sql() -> dict[str, str]:
    return _SQL | {k: f"{_FILE} {_outcomes(failing)}" for k, (_, failing) in _PAIRS.items()}
