"""Twenty rules in a fixed order: metadata and schema on the driver, data in one aggregation.

A fatal failure ends the run; the rules behind it are reported as not run. Messages of the data
rules are those of the first failing value, by step of 1024 rows, geometry column and row.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DuplicateMetadataError, GeometryError, NoMetadataError
from ..functions import bbox
from ..functions import columns as columns_
from ..functions import geometry as g
from ..functions.batches import NAMES, Batch
from ..metadata import COUNTERCLOCKWISE, EDGES, GEOMETRY_TYPES, KEY, GeoMetadata, footer_value
from ..sources import footers, geojson, schema, storage
from . import projjson

STEP = 1024
TITLES = [
    f'file must include a "{KEY}" metadata key',
    "metadata must be a JSON object",
    'metadata must include a "version" string',
    'metadata must include a "primary_column" string',
    'metadata must include a "columns" object',
    'column metadata must include the "primary_column" name',
    'column metadata must include a valid "encoding" string',
    'column metadata must include a "geometry_types" list',
    'optional "crs" must be null or a PROJJSON object',
    'optional "orientation" must be a valid string',
    'optional "edges" must be a valid string',
    'optional "bbox" must be an array of 4 or 6 numbers',
    'optional "epoch" must be a number',
    "geometry columns must not be grouped",
    "geometry columns must be stored using the BYTE_ARRAY parquet type",
    "geometry columns must be required or optional, not repeated",
    'all geometry values match the "encoding" metadata',
    'all geometry types must be included in the "geometry_types" metadata (if not empty)',
    'all polygon geometries must follow the "orientation" metadata (if present)',
    'all geometries must fall within the "bbox" metadata (if present)',
]
METADATA_RULES = 16


@dataclass
class Check:
    title: str
    run: bool = False
    passed: bool = False
    message: str = ""


class Failure(Exception):
    def __init__(self, message: str, fatal: bool = False):
        super().__init__(message)
        self.fatal = fatal


def fatal(message: str) -> Failure:
    return Failure(message, True)


@dataclass
class Report:
    checks: list[Check]
    metadata_only: bool = False

    @property
    def valid(self) -> bool:
        """Every check has passed; one that wasn't run hasn't."""
        return all(c.passed for c in self.checks)

    def to_dict(self) -> dict:
        checks = [{k: v for k, v in asdict(c).items() if k != "message" or v} for c in self.checks]
        return {"checks": checks, "metadataOnly": self.metadata_only}

    def to_json(self, pretty: bool = True) -> str:
        return json.dumps(self.to_dict(), indent=2 if pretty else None, separators=None if pretty else (",", ":"), ensure_ascii=False)

    def tally(self) -> tuple[int, int, int]:
        """Passed, failed, not run."""
        run = [c for c in self.checks if c.run]
        passed = sum(c.passed for c in run)
        return passed, len(run) - passed, len(self.checks) - len(run)

    def to_text(self) -> str:
        passed, failed, unrun = self.tally()
        checks = lambda n: f"{n} check{'' if n == 1 else 's'}"
        summary = [f"Passed {checks(passed)}"] + [f"failed {checks(failed)}"] * (failed > 0) + [f"{checks(unrun)} not run"] * (unrun > 0)
        out = ["", f"Summary: {', '.join(summary)}.", ""]
        if self.metadata_only:
            out += [f"Metadata and schema checks only.  Skipped {len(TITLES) - METADATA_RULES} data scanning checks.", ""]
        for c in self.checks:
            mark, reason = (" !", "not checked") if not c.run else (" ✓", "") if c.passed else (" ✗", c.message)
            out += [f"{mark} {c.title}"] + [f"   ↳ {reason}"] * bool(reason)
        return "\n".join([*out, ""])

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, c.title, c.run, c.passed, c.message) for i, c in enumerate(self.checks, 1)]
        return spark.createDataFrame(rows, "ord int, title string, run boolean, passed boolean, message string")


def as_json(value) -> str:
    text = json.dumps(geojson._plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return text.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")


def json_type(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return {str: "string", dict: "object", list: "list"}.get(type(value), "<nil>")


def _number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _quote(value: str) -> str:
    return json.dumps(value, ensure_ascii=False)


def _version(m: dict) -> None:
    if "version" not in m:
        raise Failure('missing "version" in metadata')
    if not isinstance(m["version"], str):
        raise Failure(f'expected "version" to be a string, got {as_json(m["version"])}')
    if not m["version"]:
        raise Failure('expected "version" to be a non-empty string')


def _primary(m: dict) -> None:
    if "primary_column" not in m:
        raise Failure('missing "primary_column" in metadata')
    if not isinstance(m["primary_column"], str):
        raise Failure(f'expected "primary_column" to be a string, got {as_json(m["primary_column"])}')


def _columns(m: dict) -> None:
    if "columns" not in m:
        raise fatal('missing "columns" in metadata')
    if not isinstance(m["columns"], dict):
        raise fatal(f'expected "columns" to be an object, got {as_json(m["columns"])}')
    for name, value in sorted(m["columns"].items()):
        if not isinstance(value, dict):
            raise fatal(f"expected column {_quote(name)} to be an object, got {as_json(value)}")


def _encoding(name: str, c: dict) -> None:
    if "encoding" not in c:
        raise Failure(f'missing "encoding" for column {_quote(name)}')
    if not isinstance(c["encoding"], str):
        raise Failure(f'expected "encoding" for column {_quote(name)} to be a string, got {as_json(c["encoding"])}')
    if c["encoding"] != "WKB":
        raise Failure(f"unsupported encoding {_quote(c['encoding'])} for column {_quote(name)}")


def _types(name: str, c: dict) -> None:
    if "geometry_types" not in c:
        raise Failure(f'missing "geometry_types" for column {_quote(name)}')
    value = c["geometry_types"]
    if not isinstance(value, list):
        raise Failure(f'expected "geometry_types" for column {_quote(name)} to be a list, got {as_json(value)}')
    for t in value:
        if not isinstance(t, str):
            raise Failure(f'expected "geometry_types" for column {_quote(name)} to be a list of strings, got {as_json(value)}')
        if t not in GEOMETRY_TYPES:
            raise Failure(f"unsupported geometry type {_quote(t)} for column {_quote(name)}")


def _crs(name: str, c: dict) -> None:
    crs = c.get("crs")
    if crs is None:
        return
    if not isinstance(crs, dict):
        raise fatal(f'expected "crs" for column {_quote(name)} to be an object, got a {json_type(crs)}: {as_json(crs)}')
    url = crs["$schema"] if isinstance(crs.get("$schema"), str) else "https://proj.org/schemas/v0.6/projjson.schema.json"
    if wrong := projjson.problem(crs):
        raise Failure(f"validation failed against {url}: {wrong}")


def _orientation(name: str, c: dict) -> None:
    if "orientation" in c:
        v = c["orientation"]
        if not isinstance(v, str):
            raise fatal(f'expected "orientation" for column {_quote(name)} to be a string, got a {json_type(v)}: {as_json(v)}')
        if v != COUNTERCLOCKWISE:
            raise Failure(f'unsupported orientation {_quote(v)} for column {_quote(name)}, expected "{COUNTERCLOCKWISE}"')


def _edges(name: str, c: dict) -> None:
    if "edges" in c:
        v = c["edges"]
        if not isinstance(v, str):
            raise fatal(f'expected "edges" for column {_quote(name)} to be a string, got a {json_type(v)}: {as_json(v)}')
        if v not in EDGES:
            raise Failure(f'unsupported edges {_quote(v)} for column {_quote(name)}, expected "{EDGES[0]}" or "{EDGES[1]}"')


def _bbox(name: str, c: dict) -> None:
    if "bbox" in c:
        v = c["bbox"]
        if not isinstance(v, list):
            raise fatal(f'expected "bbox" for column {_quote(name)} to be a list, got a {json_type(v)}: {as_json(v)}')
        if len(v) not in (4, 6):
            raise Failure(f'expected "bbox" for column {_quote(name)} to be a list of 4 or 6 numbers, got {as_json(v)}')
        if not all(map(_number, v)):
            raise fatal(f'expected "bbox" for column {_quote(name)} to be a list of numbers, got {as_json(v)}')


def _epoch(name: str, c: dict) -> None:
    if "epoch" in c and not _number(c["epoch"]):
        raise fatal(f'expected "epoch" for column {_quote(name)} to be a number, got a {json_type(c["epoch"])}: {as_json(c["epoch"])}')


class _Run:
    def __init__(self, metadata_only: bool):
        self.report = Report([Check(t) for t in TITLES[: METADATA_RULES if metadata_only else len(TITLES)]], metadata_only)
        self.over = False

    def check(self, number: int, rule: Callable[[], None]) -> None:
        if self.over:
            return
        check = self.report.checks[number - 1]
        check.run = True
        try:
            rule()
            check.passed = True
        except Failure as e:
            check.message, self.over = str(e), e.fatal


def report(pairs: list[tuple[str, str]], root: schema.Node, df: DataFrame | None) -> Report:
    """Of footer pairs, a schema tree and the rows (None: metadata rules only)."""
    run = _Run(df is None)
    held: dict = {}

    def key() -> None:
        if not any(k == KEY for k, _ in pairs):
            raise fatal(f'missing "{KEY}" metadata key')

    def an_object() -> None:
        try:
            held["raw"] = json.loads(footer_value(pairs))
        except (NoMetadataError, DuplicateMetadataError) as e:
            raise fatal(str(e)) from e
        except ValueError:
            held["raw"] = None
        if not isinstance(held["raw"], dict):
            raise fatal("failed to parse file metadata as a JSON object")

    run.check(1, key)
    run.check(2, an_object)
    if run.over:
        return run.report
    raw = held["raw"]
    for number, rule in ((3, _version), (4, _primary), (5, _columns)):
        run.check(number, lambda r=rule: r(raw))
    if run.over:
        return run.report
    columns = sorted(raw["columns"].items())

    def each(rule) -> Callable[[], None]:
        def all_columns() -> None:
            for name, c in columns:
                rule(name, c)

        return all_columns

    for number, rule in ((7, _encoding), (8, _types), (9, _crs), (10, _orientation), (11, _edges), (12, _bbox), (13, _epoch)):
        run.check(number, each(rule))
    if run.over:
        return run.report
    primary = raw.get("primary_column") if isinstance(raw.get("primary_column"), str) else ""

    def lookup() -> None:
        if primary not in raw["columns"]:
            raise Failure(f"the {_quote(primary)} column is not included in the column metadata")

    def node(name: str) -> schema.Node:
        found = root.child(name)
        if found is None:
            raise fatal(f"missing geometry column {_quote(name)}")
        return found

    def ungrouped(name: str, _: dict) -> None:
        if node(name).group:
            raise Failure(f"column {_quote(name)} must not be a group")

    def stored(name: str, _: dict) -> None:
        n = node(name)
        if n.group:
            raise fatal(f"expected primitive column for {_quote(name)}")
        if n.physical != "binary":
            raise fatal(f"unexpected type for column {_quote(name)}, got {n.physical.upper()}")

    def unrepeated(name: str, _: dict) -> None:
        if node(name).repetition == "repeated":
            raise Failure(f"column {_quote(name)} must not be repeated")

    run.check(6, lookup)
    for number, rule in ((14, ungrouped), (15, stored), (16, unrepeated)):
        run.check(number, each(rule))
    if df is not None and not run.over:
        _data(run, df, GeoMetadata(raw))
    return run.report


_SEEN = "struct<error:string,kind:string,ring:string,xmin:double,ymin:double,xmax:double,ymax:double>"
_SEEN_ARROW = pa.struct([(n, pa.string()) for n in ("error", "kind", "ring")] + [(n, pa.float64()) for n in ("xmin", "ymin", "xmax", "ymax")])


def _looked_at(c, encoding: str, rings: bool):
    """Everything that the data rules ask of a value, from one parse; null for null and empty."""

    @F.arrow_udf(_SEEN)
    def apply(values: pa.Array) -> pa.Array:
        n = len(values)
        texts = {k: np.full(n, None, object) for k in ("error", "kind", "ring")}
        box, none, boxless = np.zeros((n, 4)), np.ones(n, bool), np.ones(n, bool)
        alone = columns_.unplain(values, encoding)
        if len(alone) < n:
            batch = Batch(values)
            box[batch.plain], none[batch.plain], boxless[batch.plain] = batch.boxes(), False, False
            texts["kind"][batch.plain] = NAMES[batch.kind[batch.plain]]
            texts["ring"][batch.plain] = ""
            if rings:
                texts["ring"] = np.array(columns_.ring_problems(batch, values) if not len(alone) else _rings(batch, values), object)
        for i in alone:
            v = values[int(i)].as_py()
            try:
                shape = g.decode(v, encoding)
            except (GeometryError, ValueError, TypeError) as e:
                texts["error"][i], none[i] = str(e), False
                continue
            if shape is None:
                continue
            parsed = g.parse_wkb(v if isinstance(v, bytes) else g.to_wkb(shape))
            own = g.bounds_of(g._flat(parsed))
            none[i], texts["kind"][i], texts["ring"][i] = False, parsed[0], g.rings_follow(parsed) if rings else ""
            if own:
                box[i], boxless[i] = own, False
        fields = [pa.array(texts[k].tolist(), pa.string()) for k in ("error", "kind", "ring")] + [pa.array(box[:, k], mask=boxless) for k in range(4)]
        return pa.StructArray.from_arrays(fields, [f.name for f in _SEEN_ARROW], mask=pa.array(none))

    return apply(c)


def _rings(batch: Batch, values: pa.Array) -> list[str | None]:
    """Ring problems of plain values alone, as others may not be readable."""
    plain = values.filter(pa.array(batch.plain))
    out = np.full(len(values), None, object)
    out[batch.plain] = columns_.ring_problems(Batch(plain), plain)
    return out.tolist()


def _data(run: _Run, df: DataFrame, metadata: GeoMetadata) -> None:
    """Rules 17 to 20 over every geometry column in one aggregation."""
    order = F.col("_row")
    columns = [(i, n, metadata.columns[n]) for i, n in enumerate(sorted(metadata.columns)) if n in df.columns]
    seen = df.select("_row", *[_looked_at(F.col(f"`{n}`"), c.get("encoding") if isinstance(c.get("encoding"), str) else "", c.get("orientation") == COUNTERCLOCKWISE).alias(f"_s{i}") for i, n, c in columns])
    sums = []
    for i, name, c in columns:
        s = F.col(f"_s{i}")
        there = s.isNotNull() & s.error.isNull()
        q = _quote(name)
        first = {17: F.when(s.error.isNotNull(), F.concat(F.lit(f"invalid geometry in column {q}: "), s.error))}
        types = metadata.geometry_types(name)
        if types:
            fits = s.kind.isin(types) | F.concat(s.kind, F.lit(" Z")).isin(types)
            first[18] = F.when(there & ~fits, F.concat(F.lit('unexpected geometry type "'), s.kind, F.lit(f'" for column {q}')))
        orientation = c.get("orientation")
        if orientation == COUNTERCLOCKWISE:
            first[19] = F.when(there & (s.ring != ""), F.concat(F.lit("invalid orientation for "), s.ring, F.lit(f" ring in column {q}")))
        elif orientation:
            first[19] = F.when(there, F.lit(f"unsupported orientation {_quote(orientation)} for column {q}"))
        limits = c.get("bbox")
        if limits:
            if len(limits) not in (4, 6):
                first[20] = F.when(there, F.lit(f"invalid bbox length for column {q}"))
            else:
                off = bbox.within(s, [float(x) for x in limits])
                side = F.when(off.side == "outside", F.lit("outside of the bbox")).otherwise(F.concat(off.side, F.lit(" of the bbox")))
                first[20] = F.when(there & off.isNotNull(), F.concat(F.lit(f"geometry in column {q} extends to "), F.format_string("%f", off.value), F.lit(", "), side))
        at = F.struct(F.floor(order / STEP).alias("step"), F.lit(i).alias("column"), order.alias("row"))
        sums += [F.min(F.when(m.isNotNull(), F.struct(at.alias("at"), m.alias("message")))).alias(f"_{rule}_{i}") for rule, m in first.items()]
    found = seen.agg(*sums).first().asDict() if sums else {}
    for rule in (17, 18, 19, 20):
        failures = [v for k, v in found.items() if k.startswith(f"_{rule}_") and v is not None]
        message = min(failures, key=lambda v: tuple(v["at"]))["message"] if failures else ""

        def outcome(message: str = message, rule: int = rule) -> None:
            if message:
                raise Failure(message, rule == 17)

        run.check(rule, outcome)


def validate(spark: SparkSession, path: str, metadata_only: bool = False) -> Report:
    """Of a file, or of a folder by its first file's footer and all files' rows, in order of the
    files' addresses."""
    file = storage.open_parquet(path)
    df = None
    if not metadata_only:
        path_ = storage.readable(path)
        row = F.col("_metadata.row_index")
        df = spark.read.parquet(path_)
        if len(storage.parquet_files(path_)) > 1:
            starts = footers.file_starts(spark, path_).select(footers.file_key(F.col("file")).alias("_file"), "start")
            own = df.select("*", footers.file_key(F.col("_metadata.file_path")).alias("_file"), row.alias("_at"))
            df = own.join(starts, "_file").select(*[f"`{c}`" for c in df.columns], (F.col("start") + F.col("_at")).alias("_row"))
        else:
            df = df.select("*", row.alias("_row"))
    return report(footers.pairs(path), schema.tree(file.schema), df)
