"""The driver's queries for the engine's own operators, and SQL that gives the same rows.

The test tables hold no geometry, so boxes and shapes are made of integer keys on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bbox, columns
from .functions.bbox import Bbox
from .metadata import GeoMetadata
from .operators import extract as extracting
from .operators import stats
from .plans import boxes
from .sources import geojson, geoparquet

META = GeoMetadata({"version": "1.0.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": []}}})
QUERY = Bbox(-20, -10, 30, 10)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(df: DataFrame, key: str) -> DataFrame:
    k = F.col(key)
    return df.withColumns({"lon": (((k * 37) % 360) - 180).cast("double"), "lat": (((k * 17) % 180) - 90).cast("double"), "w": (k % 7 + 1).cast("double")})


def _boxed(df: DataFrame, key: str) -> DataFrame:
    """A box for each row; those over the antimeridian end west."""
    east = F.col("lon") + F.col("w")
    box = F.struct(F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), F.when(east > 180, east - 360).otherwise(east).alias("xmax"), (F.col("lat") + F.col("w")).alias("ymax"))
    return _place(df, key).withColumn("bbox", box)


_PLACED = "((k*37)%360)-180 AS lon, ((k*17)%180)-90 AS lat, k%7+1 AS w"
_BOXED = f"""placed AS (SELECT *, {_PLACED} FROM src),
boxed AS (SELECT *, lon::DOUBLE AS xmin, lat::DOUBLE AS ymin, (CASE WHEN lon+w>180 THEN lon+w-360 ELSE lon+w END)::DOUBLE AS xmax, (lat+w)::DOUBLE AS ymax FROM placed)"""


def _hit(q: Bbox) -> str:
    s = q.shifted()
    return f"(ymax >= {s.ymin} AND ymin <= {s.ymax} AND xmax >= {s.xmin} AND (CASE WHEN xmin>0 AND xmax<0 THEN xmin-360 ELSE xmin END) <= {s.xmax})"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _boxed(_read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), "c_custkey")
    return geoparquet.with_metadata(df.withColumn("geometry", F.lit(None).cast("binary")), META)


_SRC_CUSTOMER = "src AS (SELECT c_custkey AS k, c_custkey, c_name, c_nationkey, c_acctbal FROM customer)"
_FLAT = "xmin, ymin, xmax, ymax"


def _by_box(q: Bbox, keep: list[str] | None = None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = extracting.extract(_customers(spark, sf_dir), q, keep=[*keep, "geometry"] if keep else None)
        if keep:
            return df.drop("geometry")
        return df.select("c_custkey", "bbox.xmin", "bbox.ymin", "bbox.xmax", "bbox.ymax")

    cols = ", ".join(keep) if keep else f"c_custkey, {_FLAT}"
    return query, f"WITH {_SRC_CUSTOMER}, {_BOXED} SELECT {cols} FROM boxed WHERE {_hit(q)}"


def extract_keep_cols(spark, sf_dir):
    return extracting.extract(_customers(spark, sf_dir), keep=["c_name", "no_such", "c_custkey", "geometry"]).drop("geometry")


def extract_drop_cols(spark, sf_dir):
    return extracting.extract(_customers(spark, sf_dir), drop=["c_name", "bbox", "lon", "lat", "w", "no_such"]).drop("geometry")


def extract_bbox_events(spark, sf_dir):
    df = _boxed(_read(spark, sf_dir, "events").select("event_id"), "event_id")
    return df.where(bbox.intersects(F.col("bbox"), QUERY)).select("event_id", "bbox.xmin", "bbox.ymin", "bbox.xmax", "bbox.ymax")


def _shape_text(df: DataFrame, kind: str) -> DataFrame:
    """WKT of a point, a line or a polygon at each row's place."""
    i = lambda c: F.col(c).cast("long").cast("string")
    e, n = (F.col("lon") + F.col("w")).cast("long").cast("string"), (F.col("lat") + F.col("w")).cast("long").cast("string")
    lon, lat = i("lon"), i("lat")
    text = {
        "point": F.concat(F.lit("POINT("), lon, F.lit(" "), lat, F.lit(")")),
        "line": F.concat(F.lit("LINESTRING("), lon, F.lit(" "), lat, F.lit(","), e, F.lit(" "), n, F.lit(")")),
        "polygon": F.concat(F.lit("POLYGON(("), lon, F.lit(" "), lat, F.lit(","), e, F.lit(" "), lat, F.lit(","), e, F.lit(" "), n, F.lit(","), lon, F.lit(" "), n, F.lit(","), lon, F.lit(" "), lat, F.lit("))")),
    }[kind]
    return df.withColumn("wkt", text)


_SHAPE_SQL = {
    "point": "format('POINT({} {})', lon, lat)",
    "line": "format('LINESTRING({} {},{} {})', lon, lat, lon+w, lat+w)",
    "polygon": "format('POLYGON(({} {},{} {},{} {},{} {},{} {}))', lon, lat, lon+w, lat, lon+w, lat+w, lon, lat+w, lon, lat)",
}


def _shapes(spark, sf_dir, kind: str) -> DataFrame:
    return _shape_text(_place(_read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey"), kind)


def _shape_source(kind: str) -> str:
    return f"WITH {_SRC_CUSTOMER}, placed AS (SELECT *, {_PLACED} FROM src), shaped AS (SELECT *, {_SHAPE_SQL[kind]} AS wkt FROM placed)"


def _wkt_to_wkb(kind: str):
    def query(spark, sf_dir):
        return _shapes(spark, sf_dir, kind).select("c_custkey", F.hex(columns.wkt_to_wkb("wkt")).alias("wkb"))

    return query, f"{_shape_source(kind)} SELECT c_custkey, hex(ST_AsWKB(wkt::GEOMETRY)) AS wkb FROM shaped"


def _wkb_to_wkt(kind: str):
    def query(spark, sf_dir):
        return _shapes(spark, sf_dir, kind).withColumn("g", columns.wkt_to_wkb("wkt")).select("c_custkey", columns.wkb_to_wkt("g").alias("text"))

    return query, f"{_shape_source(kind)} SELECT c_custkey, replace(replace(ST_AsText(wkt::GEOMETRY), ' (', '('), ', ', ',') AS text FROM shaped"


def _envelope(kind: str):
    east, north = ("lon", "lat") if kind == "point" else ("lon+w", "lat+w")

    def query(spark, sf_dir):
        df = _shapes(spark, sf_dir, kind).withColumn("e", columns.envelope(columns.wkt_to_wkb("wkt")))
        return df.select("c_custkey", "e.xmin", "e.ymin", "e.xmax", "e.ymax")

    return query, f"{_shape_source(kind)} SELECT c_custkey, lon::DOUBLE AS xmin, lat::DOUBLE AS ymin, ({east})::DOUBLE AS xmax, ({north})::DOUBLE AS ymax FROM shaped"


def geojson_to_wkb(spark, sf_dir):
    df = _place(_read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    text = F.concat(F.lit('{"type":"Point","coordinates":['), F.col("lon").cast("long"), F.lit(","), F.col("lat").cast("long"), F.lit("]}"))
    return df.select("c_custkey", F.hex(columns.geojson_to_wkb(text)).alias("wkb"))


def wkb_to_geojson_coords(spark, sf_dir):
    df = _shapes(spark, sf_dir, "line").withColumn("j", columns.wkb_to_geojson(columns.wkt_to_wkb("wkt")))
    at = lambda i, k: F.get_json_object("j", f"$.coordinates[{i}][{k}]").cast("double")
    return df.select("c_custkey", F.get_json_object("j", "$.type").alias("kind"), at(0, 0).alias("x0"), at(0, 1).alias("y0"), at(1, 0).alias("x1"), at(1, 1).alias("y1"))


_KINDS = {"point": "Point", "line": "LineString", "polygon": "Polygon"}


def _mixed(spark, sf_dir) -> DataFrame:
    """Points, lines and polygons by turns."""
    shapes = [_shapes(spark, sf_dir, k).where(F.col("c_custkey") % 3 == i) for i, k in enumerate(_KINDS)]
    return shapes[0].unionByName(shapes[1]).unionByName(shapes[2]).withColumn("geometry", columns.wkt_to_wkb("wkt"))


_MIXED = f"""WITH {_SRC_CUSTOMER}, placed AS (SELECT *, {_PLACED} FROM src),
shaped AS (SELECT *, CASE c_custkey%3 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' ELSE 'Polygon' END AS kind,
lon::DOUBLE AS xmin, lat::DOUBLE AS ymin, (CASE WHEN c_custkey%3=0 THEN lon ELSE lon+w END)::DOUBLE AS xmax, (CASE WHEN c_custkey%3=0 THEN lat ELSE lat+w END)::DOUBLE AS ymax FROM placed)"""


def geometry_type(spark, sf_dir):
    return _mixed(spark, sf_dir).select("c_custkey", columns.geometry_type("geometry").alias("kind"))


def extract_bbox_computed(spark, sf_dir):
    df = geoparquet.with_metadata(_mixed(spark, sf_dir).select("c_custkey", "geometry"), META)
    return extracting.extract(df, QUERY).select("c_custkey")


def stats_bounds(spark, sf_dir):
    got = stats.geometry_stats(_mixed(spark, sf_dir).select("geometry"), ["geometry"])
    return got.select("column", "xmin", "ymin", "xmax", "ymax")


def stats_types(spark, sf_dir):
    got = stats.geometry_stats(_mixed(spark, sf_dir).select("geometry"), ["geometry"])
    return got.select("column", F.concat_ws(",", "types").alias("types"))


def stats_by_group(spark, sf_dir):
    df = _mixed(spark, sf_dir).select(F.floor(F.col("c_custkey") / 50).alias("row_group"), "geometry")
    return stats.geometry_stats(df, ["geometry"], ["row_group"]).select("row_group", "column", "xmin", "ymin", "xmax", "ymax", F.concat_ws(",", "types").alias("types"))


def ring_orientation(spark, sf_dir):
    df = _shapes(spark, sf_dir, "polygon")
    lon, lat = F.col("lon").cast("long"), F.col("lat").cast("long")
    w = F.col("w").cast("long")
    back = F.format_string("POLYGON((%d %d,%d %d,%d %d,%d %d))", lon, lat, lon, lat + w, lon + w, lat + w, lon, lat)
    turned = F.when(F.col("c_custkey") % 4 == 0, back).otherwise(F.col("wkt"))
    return df.select("c_custkey", columns.ring_problem(columns.wkt_to_wkb(turned)).alias("problem"))


def features_to_properties(spark, sf_dir):
    df = geoparquet.with_metadata(_mixed(spark, sf_dir).select("c_custkey", "lon", "w", "geometry"), META)
    lines = geojson.feature_lines(df)
    at = lambda p: F.get_json_object("value", p)
    return lines.select(at("$.properties.c_custkey").cast("long").alias("c_custkey"), at("$.properties.lon").cast("double").alias("lon"), at("$.properties.w").cast("double").alias("w"), at("$.type").alias("feature"), at("$.geometry.type").alias("kind"))


def wkt_polygon_bbox_query(spark, sf_dir):
    """A table whose geometry is text, filtered by its computed box."""
    df = geoparquet.with_metadata(_shapes(spark, sf_dir, "polygon").select("c_custkey", F.col("wkt").alias("geometry")), META)
    return extracting.extract(df, Bbox(100, -30, 140, 30)).select("c_custkey")


def box_column_discovery(spark, sf_dir):
    """A box column under another name and with other field names, found through `covering`."""
    df = _customers(spark, sf_dir)
    own = F.struct(F.col("bbox.xmin").alias("w"), F.col("bbox.ymin").alias("s"), F.col("bbox.xmax").alias("e"), F.col("bbox.ymax").alias("n"))
    meta = META.clone()
    meta.column("geometry")["covering"] = {"bbox": {k: ["extent", f] for k, f in zip(boxes.FIELDS, "wsen")}}
    df = geoparquet.with_metadata(df.withColumn("extent", own).drop("bbox"), meta)
    return extracting.extract(df, QUERY).select("c_custkey")


_PAIRS = {
    "extract_bbox_column": _by_box(QUERY),
    "extract_bbox_antimeridian_row": _by_box(Bbox(-180, -90, -170, 90)),
    "extract_bbox_antimeridian_query": _by_box(Bbox(170, -90, -170, 90)),
    "extract_bbox_touch": _by_box(Bbox(-8, -30, -8, 30)),
    "extract_bbox_empty": _by_box(Bbox(500, 500, 501, 501)),
    "extract_bbox_globe": _by_box(Bbox(-180, -90, 180, 90)),
    "extract_bbox_and_cols": _by_box(QUERY, ["c_custkey", "c_name", "c_acctbal"]),
    **{f"wkt_to_wkb_{k}": _wkt_to_wkb(k) for k in _KINDS},
    **{f"wkb_to_wkt_{k}": _wkb_to_wkt(k) for k in _KINDS},
    **{f"envelope_{k}": _envelope(k) for k in _KINDS},
}
_PLAIN = [
    extract_keep_cols, extract_drop_cols, extract_bbox_events, extract_bbox_computed, geojson_to_wkb, wkb_to_geojson_coords, geometry_type, stats_bounds, stats_types, stats_by_group,
    ring_orientation, features_to_properties,
    wkt_polygon_bbox_query, box_column_discovery,
]
_SQL = {
    "extract_keep_cols": "SELECT c_custkey, c_name FROM customer",
    "extract_drop_cols": "SELECT c_custkey, c_nationkey, c_acctbal FROM customer",
    "extract_bbox_events": f"WITH src AS (SELECT event_id AS k, event_id FROM events), {_BOXED} SELECT event_id, {_FLAT} FROM boxed WHERE {_hit(QUERY)}",
    "extract_bbox_computed": f"{_MIXED}, g AS (SELECT c_custkey, (CASE kind WHEN 'Point' THEN {_SHAPE_SQL['point']} WHEN 'LineString' THEN {_SHAPE_SQL['line']} ELSE {_SHAPE_SQL['polygon']} END)::GEOMETRY AS g FROM shaped) SELECT c_custkey FROM g WHERE ST_Intersects_Extent(g, 'POLYGON((-20 -10,30 -10,30 10,-20 10,-20 -10))'::GEOMETRY)",
    "geojson_to_wkb": f"{_shape_source('point')} SELECT c_custkey, hex(ST_AsWKB(ST_GeomFromGeoJSON(format('{{{{\"type\":\"Point\",\"coordinates\":[{{}},{{}}]}}}}', lon, lat)))) AS wkb FROM shaped",
    "wkb_to_geojson_coords": f"{_shape_source('line')} SELECT c_custkey, 'LineString' AS kind, lon::DOUBLE AS x0, lat::DOUBLE AS y0, (lon+w)::DOUBLE AS x1, (lat+w)::DOUBLE AS y1 FROM shaped",
    "geometry_type": f"{_MIXED} SELECT c_custkey, kind FROM shaped",
    "stats_bounds": f"{_MIXED} SELECT 'geometry' AS \"column\", min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM shaped",
    "stats_types": f"{_MIXED} SELECT 'geometry' AS \"column\", string_agg(DISTINCT kind, ',' ORDER BY kind) AS types FROM shaped",
    "stats_by_group": f"{_MIXED} SELECT c_custkey//50 AS row_group, 'geometry' AS \"column\", min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, string_agg(DISTINCT kind, ',' ORDER BY kind) AS types FROM shaped GROUP BY 1",
    # twice the signed area of the ring's corners, in the order they are written
    "ring_orientation": f"""WITH {_SRC_CUSTOMER}, placed AS (SELECT *, {_PLACED} FROM src),
corners AS (SELECT c_custkey, unnest(CASE WHEN c_custkey%4=0 THEN [[lon,lat],[lon,lat+w],[lon+w,lat+w],[lon,lat]] ELSE [[lon,lat],[lon+w,lat],[lon+w,lat+w],[lon,lat+w],[lon,lat]] END) AS p,
generate_subscripts(CASE WHEN c_custkey%4=0 THEN [1,2,3,4] ELSE [1,2,3,4,5] END, 1) AS i FROM placed),
steps AS (SELECT c_custkey, p[1]*lead(p[2]) OVER w - lead(p[1]) OVER w * p[2] AS a FROM corners WINDOW w AS (PARTITION BY c_custkey ORDER BY i))
SELECT c_custkey, CASE WHEN sum(a)<0 THEN 'exterior' ELSE '' END AS problem FROM steps GROUP BY 1""",
    "features_to_properties": f"{_MIXED} SELECT c_custkey, lon::DOUBLE AS lon, w::DOUBLE AS w, 'Feature' AS feature, kind FROM shaped",
    "wkt_polygon_bbox_query": f"{_shape_source('polygon')} SELECT c_custkey FROM shaped WHERE lat+w >= -30 AND lat <= 30 AND lon+w >= 100 AND lon <= 140",
    "box_column_discovery": f"WITH {_SRC_CUSTOMER}, {_BOXED} SELECT c_custkey FROM boxed WHERE {_hit(QUERY)}",
}


def _all() -> tuple[dict, dict]:
    from . import queries_files as files

    return {k: q for k, (q, _) in _PAIRS.items()} | {f.__name__: f for f in _PLAIN} | files.queries(), {k: s for k, (_, s) in _PAIRS.items()} | _SQL | files.oracle_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all()[0]


def oracle_sql() -> dict[str, str]:
    return _all()[1]
