"""The `geo` document of a Parquet footer. The raw JSON object is kept, so nothing in it is lost."""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass, field

from .errors import DuplicateMetadataError, MetadataError, NoMetadataError

VERSION = "1.0.0"
KEY = "geo"
DEFAULT_COLUMN = "geometry"
WKB, WKT = "WKB", "WKT"
COUNTERCLOCKWISE = "counterclockwise"
EDGES = ("planar", "spherical")
_NAMES = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")
GEOMETRY_TYPES = (*_NAMES, *(f"{n} Z" for n in _NAMES))


def crs_name(crs: dict | None) -> str:
    """A CRS's name, else authority:code, else Unknown."""
    crs = crs or {}
    if crs.get("name"):
        return crs["name"]
    ident = crs.get("id") or {}
    code = ident.get("code")
    if isinstance(code, str):
        return f"{ident.get('authority', '')}:{code}"
    if isinstance(code, (int, float)) and not isinstance(code, bool):
        return f"{ident.get('authority', '')}:{code:g}"
    return "Unknown"


@dataclass
class GeoMetadata:
    """A view of the raw document."""

    raw: dict = field(default_factory=dict)

    @classmethod
    def default(cls, column: str = DEFAULT_COLUMN, encoding: str = WKB) -> GeoMetadata:
        return cls({"version": VERSION, "primary_column": column, "columns": {column: {"encoding": encoding, "geometry_types": []}}})

    @classmethod
    def parse(cls, value: str | bytes) -> GeoMetadata:
        try:
            raw = json.loads(value)
        except ValueError as e:
            raise MetadataError(f"unable to parse {KEY} metadata: {e}") from e
        if not isinstance(raw, dict):
            raise MetadataError(f"unable to parse {KEY} metadata: expected an object")
        columns = raw.get("columns")
        if columns is not None and (not isinstance(columns, dict) or not all(isinstance(c, dict) for c in columns.values())):
            raise MetadataError(f"unable to parse {KEY} metadata: expected columns to be objects")
        for name, kind in (("version", str), ("primary_column", str)):
            if raw.get(name) is not None and not isinstance(raw[name], kind):
                raise MetadataError(f"unable to parse {KEY} metadata: expected {name} to be a string")
        return cls(raw)

    @classmethod
    def of_footer(cls, pairs: list[tuple[str, str]] | dict | None) -> GeoMetadata:
        return cls.parse(footer_value(pairs))

    @property
    def version(self) -> str:
        return self.raw.get("version") or ""

    @property
    def primary_column(self) -> str:
        return self.raw.get("primary_column") or ""

    @primary_column.setter
    def primary_column(self, name: str) -> None:
        self.raw["primary_column"] = name

    @property
    def columns(self) -> dict[str, dict]:
        return self.raw.get("columns") or {}

    def column(self, name: str) -> dict:
        return self.raw.setdefault("columns", {}).setdefault(name, {"encoding": WKB, "geometry_types": []})

    def geometry_types(self, name: str) -> list[str]:
        """The types of a column, from `geometry_types` or the older `geometry_type`; [] if unusable."""
        column = self.columns.get(name) or {}
        value = column.get("geometry_types")
        if not isinstance(value, list):
            value = column.get("geometry_type")
            value = [value] if isinstance(value, str) else value
        if not isinstance(value, list) or not all(isinstance(t, str) for t in value):
            return []
        return list(value)

    def clone(self) -> GeoMetadata:
        return GeoMetadata(copy.deepcopy(self.raw))

    def only(self, names: list[str]) -> GeoMetadata:
        """Without the entries of columns that aren't among `names`."""
        out = self.clone()
        out.raw["columns"] = {k: v for k, v in out.columns.items() if k in names}
        return out

    def to_json(self) -> str:
        return json.dumps(self.raw, separators=(",", ":"), ensure_ascii=False)


def footer_value(pairs: list[tuple[str, str]] | dict | None) -> str:
    """The one value of the key in a footer's pairs."""
    items = list(pairs.items() if isinstance(pairs, dict) else pairs or [])
    text = lambda x: x.decode() if isinstance(x, bytes) else x
    found = [text(v) for k, v in items if text(k) == KEY]
    if not found:
        raise NoMetadataError(f"missing {KEY} metadata key")
    if len(found) > 1:
        raise DuplicateMetadataError(f"found more than one {KEY} metadata key")
    return found[0]


def resolve(existing: GeoMetadata | None, columns: list[str], primary: str | None = None) -> GeoMetadata:
    """Metadata to write: `existing` or a default, with `primary` in place if it is asked for."""
    out = existing.clone() if existing else GeoMetadata.default(primary or DEFAULT_COLUMN)
    if primary:
        out.primary_column = primary
        out.column(primary)
    if out.primary_column not in columns:
        raise MetadataError(f'expected a geometry column named "{out.primary_column}"')
    return out
