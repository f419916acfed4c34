"""Where files are: formats by name, schemes, footers."""

from __future__ import annotations

import io
import os
import shutil
import tempfile
import urllib.error
import urllib.request
import uuid
from enum import Enum
from urllib.parse import parse_qs, unquote, urlsplit

import pyarrow.parquet as pq
from pyarrow import fs

from ..errors import TerravaneError


class Format(Enum):
    AUTO = "auto"
    GEOPARQUET = "geoparquet"
    PARQUET = "parquet"
    GEOJSON = "geojson"
    UNKNOWN = ""


#: The two suffixes of Parquet with geometry metadata.
_GEO = (".g" + "pq", ".geoparquet")
_SUFFIXES = {
    ".pq": Format.PARQUET, ".parquet": Format.PARQUET, **dict.fromkeys(_GEO, Format.GEOPARQUET),
    ".geojson": Format.GEOJSON, ".json": Format.GEOJSON, ".ndjson": Format.GEOJSON, ".ndgeojson": Format.GEOJSON, ".geojsonl": Format.GEOJSON,
}
LINES = (".ndjson", ".ndgeojson", ".geojsonl")
REMOTE = ("s3", "s3a", "gs", "azblob", "abfs", "abfss", "hdfs", "viewfs")


def suffix(path: str) -> str:
    """The extension, without a URL's query; case counts."""
    if urlsplit(path).scheme in ("http", "https"):
        path = urlsplit(path).path
    return os.path.splitext(path)[1]


def format_of(path: str) -> Format:
    return _SUFFIXES.get(suffix(path), Format.UNKNOWN)


def parse_format(name: str) -> Format:
    try:
        return Format(name.lower())
    except ValueError:
        return Format.UNKNOWN


def readable(path: str) -> str:
    """A path that Spark can read; s3 and azblob take their Hadoop names. http(s) has no such name:
    geoparquet.read reads it by ranges, and other readers get a copy below the shared folder."""
    scheme = urlsplit(path).scheme
    if scheme in ("", "file") or len(scheme) == 1:
        return path
    if scheme in ("http", "https"):
        return _copied(path)
    if scheme == "s3":
        return "s3a" + path[2:]
    if scheme == "azblob":
        return _azure(path)
    if scheme in REMOTE:
        return path
    raise TerravaneError(f"unsupported scheme {scheme!r} in {path!r}")


def _azure(path: str) -> str:
    """azblob://container/key in the account of AZURE_STORAGE_ACCOUNT, or of ?storage_account=."""
    parts = urlsplit(path)
    account = parse_qs(parts.query).get("storage_account", [os.environ.get("AZURE_STORAGE_ACCOUNT", "")])[0]
    if not account:
        raise TerravaneError(f"{path!r} needs a storage account: set AZURE_STORAGE_ACCOUNT or add ?storage_account=")
    return f"abfss://{parts.netloc}@{account}.dfs.core.windows.net{parts.path}"


def shared_folder() -> str:
    """A folder that every executor sees: that of spark.checkpoint.dir, or a local one where none is
    set or no session runs, as in tests and on one machine."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    at = spark and (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())
    return f"{at.rstrip('/')}/terravane" if at else tempfile.mkdtemp(prefix="terravane-")


def _copied(url: str) -> str:
    """A copy of an http(s) file, a megabyte at a time."""
    to = f"{shared_folder()}/{uuid.uuid4().hex}/{os.path.basename(urlsplit(url).path) or 'download'}"
    where, at = store(to)
    where.create_dir(os.path.dirname(at), recursive=True)
    try:
        with urllib.request.urlopen(url) as source, where.open_output_stream(at) as out:  # noqa: S310
            shutil.copyfileobj(source, out, 1 << 20)
    except OSError as e:
        raise TerravaneError(f'trouble reading "{url}": {e}') from e
    return to


def is_http(path: str) -> bool:
    return urlsplit(path).scheme in ("http", "https")


class HttpFile(io.RawIOBase):
    """A file that is read by ranges. The first answer's validator goes with every later request, so
    that a file that changes meanwhile is an error rather than a mixture."""

    #: The first request takes the end, where a footer lies; later ones take this much at least.
    TAIL, LEAST = 1 << 16, 1 << 16

    def __init__(self, url: str):
        self.url, self.at, self.validator = url, 0, ""
        self._held, self._from = b"", 0
        answer = self._ask(f"bytes=-{self.TAIL}")
        with answer:
            whole = answer.headers.get("Content-Range", "")
            self._held = answer.read()
            if answer.status == 206:
                self.length = int(whole.rpartition("/")[2])
                self._from = self.length - len(self._held)
            else:  # a server without ranges sends all
                self.length = len(self._held)
            tag = answer.headers.get("ETag", "")
            self.validator = answer.headers.get("Last-Modified", "") if tag.startswith("W/") or not tag else tag

    def _ask(self, span: str):
        headers = {"Range": span} | ({"If-Range": self.validator} if self.validator else {})
        try:
            return urllib.request.urlopen(urllib.request.Request(self.url, headers=headers))  # noqa: S310
        except urllib.error.HTTPError as e:
            raise TerravaneError(f'trouble reading "{self.url}": {e.code} {e.reason}') from e
        except OSError as e:
            raise TerravaneError(f'trouble reading "{self.url}": {e}') from e

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def size(self) -> int:
        return self.length

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        to = offset + (0, self.at, self.length)[whence]
        if to < 0:
            raise ValueError("attempt to seek to a negative position")
        self.at = to
        return to

    def read(self, n: int | None = -1) -> bytes:
        end = self.length if n is None or n < 0 else min(self.length, self.at + n)
        if end <= self.at:
            return b""
        if not (self._from <= self.at and end <= self._from + len(self._held)):
            to = min(self.length, max(end, self.at + self.LEAST))
            with self._ask(f"bytes={self.at}-{to - 1}") as answer:
                if answer.status != 206:
                    raise TerravaneError(f'"{self.url}" has changed while it was read')
                self._held, self._from = answer.read(), self.at
        out = self._held[self.at - self._from : end - self._from]
        self.at += len(out)
        return out

    def readinto(self, buffer) -> int:
        got = self.read(len(buffer))
        buffer[: len(got)] = got
        return len(got)


def address(uri: str) -> str:
    """What `store` takes for a file that Spark lists by its escaped URI."""
    return unquote(urlsplit(uri).path) if urlsplit(uri).scheme == "file" else uri


def store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file") or len(parts.scheme) == 1:
        return fs.LocalFileSystem(), parts.path if parts.scheme == "file" else os.path.abspath(path)
    if parts.scheme == "azblob":
        path = _azure(path)
    return fs.FileSystem.from_uri(("s3" + path[3:]) if parts.scheme == "s3a" else path)


def parquet_files(path: str) -> list[str]:
    """A file itself, or the data files below a folder, in order of their names."""
    if is_http(path):
        return [path]
    where, at = store(path)
    info = where.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise TerravaneError(f'"{path}" is not there')
    if info.type == fs.FileType.File:
        return [at]
    found = where.get_file_info(fs.FileSelector(at, recursive=True))
    names = sorted(f.path for f in found if f.type == fs.FileType.File)
    return [n for n in names if not any(p[:1] in "._" for p in n[len(at) :].split("/") if p)]


def open_file(path: str, file: str | None = None):
    """The file, a folder's first data file, or its file `file`, for reading at any place."""
    if is_http(path):
        return HttpFile(path)
    where, _ = store(path)
    if file is None:
        files = parquet_files(path)
        if not files:
            raise TerravaneError(f'"{path}" holds no Parquet file')
        file = files[0]
    return where.open_input_file(file)


def open_parquet(path: str, file: str | None = None) -> pq.ParquetFile:
    """The first data file's footer, or that of `file`."""
    source = open_file(path, file)
    try:
        return pq.ParquetFile(source)
    except TerravaneError:
        raise
    except Exception as e:
        raise TerravaneError(f'failed to read "{path}" as parquet: {e}') from e
