"""What a file holds: schema, codecs, counts, geometry metadata, issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..errors import MetadataError, NoMetadataError
from ..metadata import KEY, GeoMetadata, crs_name
from ..sources import footers, schema, storage


def info(path: str, spark: SparkSession | None = None) -> dict:
    """schema (nested), metadata, rows, groups, issues; of a folder, schema and metadata are those
    of the first file and counts are of all. With a session, a folder's footers are read by tasks."""
    file = storage.open_parquet(path)
    if spark:
        rows, groups = footers.totals(spark, path)
    else:
        metas = [file.metadata] if storage.is_http(path) else [storage.open_parquet(path, f).metadata for f in storage.parquet_files(path)]
        rows, groups = sum(m.num_rows for m in metas), sum(m.num_row_groups for m in metas)
    out = {"schema": schema.describe_tree(file), "metadata": None, "rows": rows, "groups": groups, "issues": []}
    try:
        out["metadata"] = GeoMetadata.of_footer(footers.pairs(path)).raw
    except NoMetadataError:
        out["issues"].append(f'not a valid GeoParquet file, as the "{KEY}" metadata key is missing; convert may make it one')
    except MetadataError:
        out["issues"].append(f'not a valid GeoParquet file, as its "{KEY}" metadata is invalid; describe --metadata-only shows the value, and validate says what is wrong')
    return out


def describe(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, depth, optional, repeated, type, annotation, compression), a row for each node."""
    rows: list[tuple] = []

    def walk(node: dict, at: str, depth: int) -> None:
        for f in node.get("fields", []):
            here = f"{at}.{f['name']}" if at else f["name"]
            rows.append((here, f["name"], depth, f.get("optional", False), f.get("repeated", False), f.get("type"), f.get("annotation"), f.get("compression")))
            walk(f, here, depth + 1)

    walk(schema.describe_tree(storage.open_parquet(path)), "", 0)
    return spark.createDataFrame(rows, "path string, name string, depth int, optional boolean, repeated boolean, type string, annotation string, compression string")


def text(found: dict) -> str:
    """A table for people."""
    meta = GeoMetadata(found["metadata"]) if found["metadata"] else None
    header = ["Column", "Type", "Annotation", "Repetition", "Compression"] + (["Encoding", "Geometry Types", "Bounds", "Detail"] if meta else [])
    lines = [header]
    for f in found["schema"].get("fields", []):
        repetition = "0..*" if f.get("repeated") else "0..1" if f.get("optional") else "1"
        line = [f["name"], f.get("type", ""), f.get("annotation", ""), repetition, f.get("compression", "")]
        if meta:
            own = meta.columns.get(f["name"])
            if own:
                detail = [f"{k}: {crs_name(own[k]) if k == 'crs' else own[k]}" for k in ("orientation", "edges", "crs") if own.get(k)]
                line += [own.get("encoding", ""), ", ".join(meta.geometry_types(f["name"])), str(own["bbox"]) if own.get("bbox") else "", "; ".join(detail)]
            else:
                line += [""] * 4
        lines.append(line)
    width = [max(len(str(r[i])) for r in lines) for i in range(len(header))]
    out = [" | ".join(str(c).ljust(w) for c, w in zip(r, width)).rstrip() for r in lines]
    out.insert(1, "-+-".join("-" * w for w in width))
    out += [f"Rows: {found['rows']}", f"Row Groups: {found['groups']}"]
    if meta:
        out.append(f"GeoParquet Version: {meta.version or 'missing'}")
    return "\n".join([*out, *(f" ! {i}" for i in found["issues"])])
