"""Command line: convert, extract, validate, describe, version."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
import uuid

from . import __commit__, __date__, __version__
from .errors import TerravaneError
from .metadata import footer_value
from .operators import convert as converting
from .operators import describe as describing
from .operators import extract as extracting
from .operators import validate as validating
from .sources import footers, geojson, geoparquet, storage


def session():
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("terravane").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
    return builder.getOrCreate()


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="terravane", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert")
    c.add_argument("paths", nargs="*", help="input and output; with standard input, the output alone")
    c.add_argument("--from", dest="source_format", default="auto", choices=["auto", "geojson", "geoparquet", "parquet"])
    c.add_argument("--to", dest="target_format", default="auto", choices=["auto", "geojson", "geoparquet"])
    c.add_argument("--min", type=int, default=geojson.MIN_FEATURES)
    c.add_argument("--max", type=int, default=geojson.MAX_FEATURES)
    c.add_argument("--input-primary-column", default=None)
    c.add_argument("--compression", default=None, choices=geoparquet.CODECS, help="of every column; Parquet input keeps its own by default")
    c.add_argument("--row-group-length", type=int, default=0)
    c.add_argument("--stats", action="store_true")
    c.add_argument("--folder", action="store_true", help="write a folder of files in parallel")
    e = sub.add_parser("extract")
    e.add_argument("paths", nargs="*")
    e.add_argument("--bbox", default=None)
    e.add_argument("--keep-only-cols", default=None)
    e.add_argument("--drop-cols", default=None)
    e.add_argument("--compression", default="zstd", choices=geoparquet.CODECS)
    e.add_argument("--folder", action="store_true")
    v = sub.add_parser("validate")
    v.add_argument("paths", nargs="*")
    v.add_argument("--metadata-only", action="store_true")
    v.add_argument("--format", default="text", choices=["text", "json"])
    v.add_argument("--unpretty", action="store_true")
    d = sub.add_parser("describe")
    d.add_argument("paths", nargs="*")
    d.add_argument("--metadata-only", action="store_true")
    d.add_argument("--format", default="text", choices=["text", "json"])
    d.add_argument("--unpretty", action="store_true")
    n = sub.add_parser("version")
    n.add_argument("--detail", action="store_true")
    return p


def _shared(name: str) -> str:
    """A new path that executors see as well."""
    session()
    path = f"{storage.shared_folder()}/{uuid.uuid4().hex}/{name}"
    where, at = storage.store(path)
    where.create_dir(os.path.dirname(at), recursive=True)
    return path


def _spooled(extension: str) -> str:
    """Standard input as a file."""
    path = _shared(f"stdin{extension}")
    where, at = storage.store(path)
    with where.open_output_stream(at) as out:
        shutil.copyfileobj(sys.stdin.buffer, out, 1 << 20)
    return path


def _input(paths: list[str], extension: str) -> str:
    return paths[0] if paths else _spooled(extension)


def _delivered(target: str | None, made: str) -> None:
    if target is None:
        where, at = storage.store(made)
        with where.open_input_stream(at) as f:
            shutil.copyfileobj(f, sys.stdout.buffer, 1 << 20)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        return globals()[f"_{args.command}"](args)
    except TerravaneError as e:
        print(f"terravane: {e}", file=sys.stderr)
        return 1


def _version(args) -> int:
    print(json.dumps({"version": __version__, "commit": __commit__, "date": __date__}) if args.detail else __version__)
    return 0


def _convert(args) -> int:
    piped = not sys.stdin.isatty() and len(args.paths) < 2 and (not args.paths or not os.path.exists(args.paths[0]))
    if piped and args.source_format == "auto":
        raise TerravaneError("when reading from standard input, the --from option must be provided")
    source = _spooled({"geojson": ".geojson"}.get(args.source_format, ".parquet")) if piped else args.paths[0]
    target = (args.paths if piped else args.paths[1:])[:1]
    if not target and args.target_format == "auto":
        raise TerravaneError("when writing to standard output, the --to option must be provided")
    made = target[0] if target else _shared("out")
    converting.convert(session(), source, made, args.source_format, args.target_format, args.min, args.max, args.input_primary_column, args.compression, args.row_group_length, args.stats, single_file=not args.folder)
    _delivered(target[0] if target else None, made)
    return 0


def _extract(args) -> int:
    piped = not sys.stdin.isatty() and len(args.paths) < 2 and (not args.paths or not os.path.exists(args.paths[0]))
    source = _spooled(".parquet") if piped else args.paths[0]
    target = (args.paths if piped else args.paths[1:])[:1]
    if target and os.path.abspath(source) == os.path.abspath(target[0]):
        raise TerravaneError("the output would replace the input")
    names = lambda x: [n.strip() for n in x.split(",")] if x else None
    df = geoparquet.read(session(), source)
    out = extracting.extract(df, args.bbox, names(args.keep_only_cols), names(args.drop_cols))
    made = target[0] if target else _shared("out.parquet")
    geoparquet.write(out, made, compression=args.compression, single_file=not args.folder)
    _delivered(target[0] if target else None, made)
    return 0


def _validate(args) -> int:
    report = validating.validate(session(), _input(args.paths, ".parquet"), args.metadata_only)
    print(report.to_json(not args.unpretty) if args.format == "json" else report.to_text())
    return 0 if report.valid else 1


def _describe(args) -> int:
    path = _input(args.paths, ".parquet")
    if args.metadata_only:
        print(footer_value(footers.pairs(path)))
        return 0
    found = describing.info(path)
    print(json.dumps(found, indent=None if args.unpretty else 2, ensure_ascii=False) if args.format == "json" else describing.text(found))
    return 0


if __name__ == "__main__":
    sys.exit(main())
