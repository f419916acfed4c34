"""GeoJSON: reading with an inferred schema, and writing.

One reader takes a FeatureCollection, a Feature, a geometry, a GeometryCollection or a sequence of
features. Files of lines and long FeatureCollections are split among tasks; any other file is one task.
"""

from __future__ import annotations

import base64
import datetime
import decimal
import json
import math
import shutil
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..errors import FeatureError, GeometryError, TerravaneError
from ..functions import geometry as g
from ..metadata import DEFAULT_COLUMN, GeoMetadata
from . import geoparquet, splits, storage

#: Least and most features that inference looks at.
MIN_FEATURES, MAX_FEATURES = 10, 100
_SPACE = " \t\r\n"
_ABSENT = object()
Parse = Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]


class _Tokens:
    """JSON values and marks of a text, one after another."""

    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.features: int | None = None  # where a collection's begin
        self.decode = json.JSONDecoder().raw_decode

    def peek(self) -> str:
        """The next character that isn't blank; empty at the end."""
        text, at = self.text, self.at
        n = len(text)
        while at < n and text[at] in _SPACE:
            at += 1
        self.at = at
        return text[at] if at < n else ""

    def skip(self, marks: str) -> None:
        while self.peek() in marks and self.peek():
            self.at += 1

    def value(self):
        if not self.peek():
            raise FeatureError("unexpected end of JSON input")
        try:
            out, self.at = self.decode(self.text, self.at)
        except ValueError as e:
            raise FeatureError(f"invalid JSON: {e}") from e
        return out


def _geometry(value, what: str = "geometry") -> dict | None:
    if value is None:
        return None
    try:
        return g.from_geojson(value)
    except GeometryError as e:
        raise FeatureError(f"trouble parsing {what}: {e}") from e


def _properties(value) -> dict:
    if value is not None and not isinstance(value, dict):
        raise FeatureError(f"trouble parsing properties: expected an object, got {json.dumps(value)}")
    return value or {}


def _member(value) -> dict:
    """A feature within a collection or a sequence: any id, and a geometry member, which may be null."""
    if not isinstance(value, dict):
        raise FeatureError(f"expected a feature, got {json.dumps(value)}")
    if "geometry" not in value:
        raise FeatureError("expected a feature with a geometry")
    return {"id": value.get("id"), "geometry": _geometry(value["geometry"]), "properties": _properties(value.get("properties"))}


def features_of(text: str | _Tokens) -> Iterator[dict]:
    """(id, geometry, properties) of each feature of a GeoJSON text, as it is parsed."""
    t = _Tokens(text) if isinstance(text, str) else text
    first = t.peek()
    if not first:
        return
    if first != "{":
        raise FeatureError(f"expected a JSON object, got {first if first in '[]}' else t.value()}")
    t.at += 1
    kind, geometry, properties, coordinates, ident, any_ = "", _ABSENT, _ABSENT, _ABSENT, _ABSENT, False
    while True:
        t.skip(",")
        if t.peek() == "}":
            t.at += 1
            break
        if not t.peek():
            if not any_:
                raise FeatureError("unexpected end of JSON input")
            break
        key = t.value()
        if not isinstance(key, str):
            raise FeatureError(f"unexpected token: {key}")
        if t.peek() != ":":
            raise FeatureError("invalid JSON: expected a colon")
        t.at += 1
        if key == "features":
            if kind not in ("", "FeatureCollection"):
                raise FeatureError(f'found features in unexpected "{kind}" type')
            if t.peek() != "[":
                raise FeatureError(f"expected an array of features, got {t.peek()}")
            t.at += 1
            t.features = t.at
            while True:
                t.skip(",")
                if t.peek() in ("]", ""):
                    if not t.peek():
                        raise FeatureError("unexpected end of JSON input")
                    return  # members behind the features aren't read
                yield _member(t.value())
        value = t.value()
        if key == "geometry":
            if geometry not in (_ABSENT, None):
                raise FeatureError("found duplicate geometry")
            geometry, any_ = _geometry(value), True
        elif key == "properties":
            if properties is not _ABSENT:
                raise FeatureError("found duplicate properties")
            properties, any_ = _properties(value), True
        elif key == "coordinates":
            if geometry not in (_ABSENT, None):
                raise FeatureError("found unexpected coordinates")
            if coordinates is not _ABSENT:
                raise FeatureError("found duplicate coordinates")
            coordinates, any_ = value, True
        elif key == "type":
            if kind:
                raise FeatureError("found duplicate type")
            if not isinstance(value, str):
                raise FeatureError(f"unexpected type: {value}")
            kind = value
        elif key == "geometries":
            if kind not in ("", "GeometryCollection"):
                raise FeatureError(f'found geometries in unexpected "{kind}" type')
            if not isinstance(value, list):
                raise FeatureError("expected an array of geometries")
            members = {"type": "GeometryCollection", "geometries": value}
            yield {"id": None, "geometry": _geometry(members) if value else None, "properties": {}}
            return
        elif key == "id":
            if ident is not _ABSENT:
                raise FeatureError("found duplicate id")
            if isinstance(value, bool) or not isinstance(value, (str, int, float)):
                raise FeatureError(f"expected id to be a string or number, got: {go_text(value)}")
            ident, any_ = value, True
    if coordinates is not _ABSENT and kind:
        yield {"id": None, "geometry": _geometry({"type": kind, "coordinates": coordinates}, "geometry coordinates"), "properties": {}}
        more = False
    else:
        if not any_:
            raise FeatureError("expected a FeatureCollection, a Feature, or a Geometry object")
        yield {"id": None if ident is _ABSENT else ident, "geometry": None if geometry is _ABSENT else geometry, "properties": {} if properties is _ABSENT else properties}
        more = True
    while more and t.peek():
        yield _member(t.value())


def _head(text: str) -> int | None:
    """Where the features of a collection begin, in a text that may end early."""
    t = _Tokens(text)
    try:
        next(features_of(t), None)
    except FeatureError:
        pass
    return t.features


def go_text(value) -> str:
    """A JSON value as it stands in messages."""
    if value is None:
        return "<nil>"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return g.number(float(value))
    if isinstance(value, list):
        return f"[{' '.join(map(go_text, value))}]"
    if isinstance(value, dict):
        return f"map[{' '.join(f'{k}:{go_text(value[k])}' for k in sorted(value))}]"
    return str(value)


class SchemaBuilder:
    """Types of properties by their first value that tells one. Null, [] and {} don't."""

    def __init__(self):
        self.fields: dict[str, T.DataType | None] = {}

    def add(self, properties: dict) -> None:
        for name, value in properties.items():
            if self.fields.get(name) is None:
                self.fields[name] = self._type(name, value, top=True)

    @property
    def ready(self) -> bool:
        return all(t is not None for t in self.fields.values())

    def _type(self, name: str, value, top: bool = False) -> T.DataType | None:
        if value is None:
            if top:
                return None
            raise FeatureError(f"error converting value for {name}: cannot convert value: {go_text(value)}")
        if isinstance(value, bool):
            return T.BooleanType()
        if isinstance(value, (int, float)):
            return T.DoubleType()
        if isinstance(value, str):
            return T.StringType()
        if isinstance(value, list):
            kinds = [self._type(name, v) for v in value]
            if not kinds or kinds[0] is None:
                return None
            if any(k != kinds[0] for k in kinds if k is not None):
                raise FeatureError(f"error converting value for {name}: expected a uniform array type")
            return T.ArrayType(kinds[0], True)
        kinds = {k: self._type(name, value[k]) for k in sorted(value)}
        if not kinds or any(k is None for k in kinds.values()):
            return None
        return T.StructType([T.StructField(k, t, True) for k, t in kinds.items()])

    def schema(self) -> T.StructType:
        """Columns by name, the geometry among them; it takes the place of a property of its name."""
        fields = {**self.fields, DEFAULT_COLUMN: T.BinaryType()}
        return T.StructType([T.StructField(n, fields[n], True) for n in sorted(fields)])


def infer(features: Iterable[dict], least: int = MIN_FEATURES, most: int = MAX_FEATURES) -> T.StructType | None:
    """The schema from a prefix: `least` features at least, and until every property has a type,
    `most` at most. None if there is no feature."""
    builder, n = SchemaBuilder(), 0
    for feature in features:
        n += 1
        builder.add(feature["properties"])
        if not builder.ready:
            if n > most:
                raise FeatureError(f"failed to create schema after reading {most} features")
        elif n >= least:
            return builder.schema()
    if not n:
        return None
    if not builder.ready:
        raise FeatureError(f"failed to create schema after reading {n} features")
    return builder.schema()


def typed(name: str, value, kind: T.DataType):
    """A property's value as its column wants it; another type is an error."""
    if value is None:
        return None
    if isinstance(kind, T.BooleanType):
        if not isinstance(value, bool):
            raise FeatureError(f'expected "{name}" to be a boolean, got {go_text(value)}')
        return value
    if isinstance(kind, T.StringType):
        if not isinstance(value, str):
            raise FeatureError(f'expected "{name}" to be a string, got {go_text(value)}')
        return value
    if isinstance(kind, T.DoubleType):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise FeatureError(f'expected "{name}" to be a float64, got {go_text(value)}')
        return float(value)
    if isinstance(kind, T.ArrayType):
        of = kind.elementType
        wanted = {T.BooleanType: "[]bool", T.StringType: "[]string", T.DoubleType: "[]float64"}.get(type(of), "[]any")
        if isinstance(of, T.ArrayType):
            raise FeatureError(f'lists of lists are not supported, in "{name}"')
        if not isinstance(value, list):
            raise FeatureError(f'expected "{name}" to be {wanted}, got {go_text(value)}')
        try:
            if any(v is None for v in value):
                raise FeatureError("")
            return [typed(name, v, of) for v in value]
        except FeatureError as e:
            if wanted == "[]any":
                raise
            raise FeatureError(f'expected "{name}" to be {wanted}, got {go_text(value)}') from e
    if not isinstance(value, dict):
        raise FeatureError(f'expected "{name}" to be map[string]any, got {go_text(value)}')
    return {f.name: typed(f.name, value.get(f.name), f.dataType) for f in kind.fields}


def _texts(spark: SparkSession, path: str, lines: bool | None, permissive: bool) -> tuple[DataFrame, Parse]:
    """A row for each line or each file, or for each range of files that are long, and what makes
    features of them. Permissive reading drops what stands behind an error, so it goes by whole files."""
    lines = storage.suffix(path) in storage.LINES if lines is None else lines
    path = storage.readable(path)
    files = None if lines or permissive else splits.files(spark, path)
    if files is None:
        return spark.read.text(path, wholetext=not lines), lambda batches: _parsed(batches, permissive)
    return splits.frame(spark, splits.ranges(spark, files, _head)), _ranged


def read(spark: SparkSession, path: str, least: int = MIN_FEATURES, most: int = MAX_FEATURES, schema: T.StructType | None = None, keep_id: bool = False, lines: bool | None = None, permissive: bool = False) -> DataFrame:
    """Features as rows: a column for each property that inference saw, and `geometry` in WKB.

    Numbers are doubles, columns come by name, properties that inference didn't see are dropped, and
    a value of another type is an error (permissive: the feature is dropped). keep_id adds `id`
    as JSON. An empty input gives no rows and a geometry column.
    """
    texts, parse = _texts(spark, path, lines, permissive)
    if schema is None:
        schema = infer(_prefix(texts, parse, most + 1), least, most) or SchemaBuilder().schema()
    kinds = [(f.name, f.dataType) for f in schema.fields]
    if keep_id:
        kinds = [k for k in kinds if k[0] != "id"] + [("id", T.StringType())]
    arrow = pa.schema([pa.field(n, to_arrow_type(t)) for n, t in kinds])

    def rows(batches: Iterator[pa.RecordBatch]):
        held: list[list] = [[] for _ in kinds]

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, arrow)], schema=arrow)
            for c in held:
                c.clear()
            return made

        for feature in parse(batches):
            try:
                row = []
                for name, kind in kinds:
                    if name == DEFAULT_COLUMN:
                        row.append(None if feature["geometry"] is None else g.to_wkb(feature["geometry"]))
                    elif keep_id and name == "id":
                        row.append(None if feature["id"] is None else json.dumps(feature["id"]))
                    else:
                        row.append(typed(name, feature["properties"].get(name), kind))
            except FeatureError:
                if permissive:
                    continue
                raise
            for c, v in zip(held, row):
                c.append(v)
            if len(held[0]) >= 1000:
                yield out()
        yield out()

    df = texts.mapInArrow(rows, T.StructType([T.StructField(n, t, True) for n, t in kinds]))
    return geoparquet.with_metadata(df, GeoMetadata.default())


def _parsed(batches: Iterator[pa.RecordBatch], permissive: bool) -> Iterator[dict]:
    for batch in batches:
        for text in batch.column(0).to_pylist():
            try:
                yield from features_of(text or "")
            except FeatureError:
                if not permissive:
                    raise


def _ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for text, whole, ended in splits.texts(batches):
        if whole:
            yield from features_of(text)
            continue
        t = _Tokens(text)
        t.skip(",")
        while t.peek():
            yield _member(t.value())
            t.skip(",")
        if not ended:
            raise FeatureError("unexpected end of JSON input")


def _prefix(texts: DataFrame, parse: Parse, n: int) -> list[dict]:
    """The first n features. Tasks stop there too, and no more than n leave each."""

    def head(batches: Iterator[pa.RecordBatch]):
        found: list[str] = []
        try:
            for feature in parse(batches):
                found.append(json.dumps({"properties": feature["properties"]}))
                if len(found) >= n:
                    break
        except FeatureError as e:  # met again when the rows are read, if they are
            found.append(json.dumps({"error": str(e)}))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["feature"])

    out = []
    for row in texts.mapInArrow(head, "feature string").limit(n).collect():
        value = json.loads(row.feature)
        if "error" in value:
            if not out:
                raise FeatureError(value["error"])
            break
        out.append(value)
    return out


def _plain(value):
    """A value as JSON has it."""
    if isinstance(value, (bytes, bytearray)):
        return base64.b64encode(value).decode()
    if isinstance(value, float):
        if math.isnan(value) or math.isinf(value):
            return None
        return int(value) if value == int(value) and abs(value) < 1e21 else value
    if isinstance(value, decimal.Decimal):
        return _plain(float(value))
    if isinstance(value, (datetime.datetime, datetime.date, datetime.time)):
        return value.isoformat()
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def feature_lines(df: DataFrame, metadata: GeoMetadata | None = None, id_column: str | None = None) -> DataFrame:
    """(value): a Feature for each row, keys sorted. The primary geometry is its geometry; other
    geometry columns and all else are properties; nulls stay. `id_column` becomes the feature's id:
    JSON of a string or a number, as `read(keep_id=True)` gives it, or any other value; null: none."""
    metadata = metadata or geoparquet.metadata_of(df) or GeoMetadata.default()
    primary, geometries = metadata.primary_column, {n: c.get("encoding") or "" for n, c in metadata.columns.items()}
    names = df.columns

    def geometry(value, name: str):
        shape = g.decode(value, geometries.get(name, ""))
        return None if shape is None else json.loads(_geo_text(shape))

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                properties, shape, ident = {}, None, None
                for name, value in zip(names, row):
                    if name == id_column:
                        ident = _id(value)
                    elif name == primary:
                        shape = geometry(value, name)
                    else:
                        properties[name] = geometry(value, name) if name in geometries else _plain(value)
                own = {} if ident is None else {"id": ident}
                out.append(json.dumps({"geometry": shape, **own, "properties": properties, "type": "Feature"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    return df.mapInArrow(rows, "value string")


def _id(value):
    """The id that a column's value stands for."""
    if not isinstance(value, str):
        return _plain(value)
    try:
        found = json.loads(value)
    except ValueError:
        return value
    return found if isinstance(found, (str, int, float)) and not isinstance(found, bool) else value


def _geo_text(shape: dict) -> str:
    from ..functions.columns import geojson_text

    return geojson_text(shape)


def write(df: DataFrame, path: str, metadata: GeoMetadata | None = None, single_file: bool = False, id_column: str | None = None) -> None:
    """A folder of files of lines, written where the rows are. single_file: one FeatureCollection,
    whose parts tasks write beside it and one task puts together, in order."""
    lines = feature_lines(df, metadata, id_column)
    if not single_file:
        lines.write.mode("overwrite").text(path)
        return
    where, at = storage.store(path)
    folder = f"{at.rpartition('/')[0]}/_temporary-{uuid.uuid4().hex}"
    where.create_dir(folder, recursive=True)
    try:
        made = _joined(df.sparkSession, path, folder, at.rpartition("/")[2], _parts(lines, path, folder))
        info = where.get_file_info([made, at])
        if info[0].type != fs.FileType.File:
            raise TerravaneError(f'tasks wrote "{path}" where the driver doesn\'t see it: name a folder that all share')
        if info[1].type == fs.FileType.Directory:
            raise TerravaneError(f'"{path}" is a folder')
        where.move(made, at)
    finally:
        where.delete_dir(folder)


def _parts(lines: DataFrame, path: str, folder: str) -> list[str]:
    """Files of the rows of each task, in the tasks' order. A task's second try has a file of its own."""

    def write(batches: Iterator[pa.RecordBatch]):
        task = TaskContext.get()
        name, out = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}", None
        try:
            for batch in batches:
                if not len(batch):
                    continue
                if out is None:
                    where, _ = storage.store(path)
                    where.create_dir(folder, recursive=True)
                    out = where.open_output_stream(name, compression=None)
                else:
                    out.write(b",\n")
                out.write(b",\n".join(batch.column(0).cast(pa.binary()).to_pylist()))
        finally:
            if out is not None:
                out.close()
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int64()), pa.array([name])], ["part", "name"])

    return [r.name for r in sorted(lines.mapInArrow(write, "part long, name string").collect())]


def _joined(spark: SparkSession, path: str, folder: str, name: str, parts: list[str]) -> str:
    """One file of the parts, a few megabytes at a time."""

    def write(batches: Iterator[pa.RecordBatch]):
        for _ in batches:
            where, _ = storage.store(path)
            made = f"{folder}/whole-{TaskContext.get().taskAttemptId()}-{name}"  # its suffix tells its compression
            where.create_dir(folder, recursive=True)
            with where.open_output_stream(made) as out:
                out.write(b'{"type":"FeatureCollection","features":[')
                for i, part in enumerate(parts):
                    out.write(b",\n" if i else b"\n")
                    with where.open_input_stream(part, compression=None) as source:
                        shutil.copyfileobj(source, out, 4 << 20)
                out.write(b"\n]}\n")
            yield pa.RecordBatch.from_arrays([pa.array([made])], ["name"])

    return spark.range(0, 1, 1, 1).mapInArrow(write, "name string").collect()[0].name


def empty(df: DataFrame) -> bool:
    return df.limit(1).select(F.lit(1)).count() == 0
