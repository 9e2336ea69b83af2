"""zip, tar and gzip files to the files in them, nested ones too."""

from __future__ import annotations

import gzip
import io
import posixpath
import tarfile
import time
import zipfile
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .documents import carried, said

FILES = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("data", T.BinaryType()), T.StructField("status", T.StringType()), T.StructField("reason", T.StringType())]))


class ArchiveError(ValueError):
    pass


@dataclass(frozen=True)
class Limits:
    max_files: int = 10_000
    max_file_bytes: int = 512 << 20
    max_total_bytes: int = 8 << 30
    max_depth: int = 3


def kind(data: bytes) -> str | None:
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return "zip"
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    return "tar" if data[257:262] == b"ustar" else None


def safe_path(name: str) -> str | None:
    """`/`-joined parts; null for absolute paths and those that climb."""
    parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".")]
    return None if name.startswith(("/", "\\")) or ".." in parts or (parts and parts[0].endswith(":")) or not parts else "/".join(parts)


def noise(path: str) -> bool:
    base = posixpath.basename(path)
    return "__MACOSX" in path.split("/") or base.startswith("._") or base in (".DS_Store", "Thumbs.db", "desktop.ini")


def gunzipped_name(name: str) -> str:
    low = name.lower()
    return f"{name[:-4]}.tar" if low.endswith(".tgz") else name[:-3] if low.endswith(".gz") else name


def gunzip(data: bytes, most: int) -> bytes | None:
    """Unpacked, or null if larger than `most`."""
    try:
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
            out = f.read(most + 1)
    except (OSError, EOFError, zlib.error) as e:
        raise ArchiveError(f"invalid input: {e}") from None
    return out if len(out) <= most else None


def _members(data: bytes, form: str, name: str, limits: Limits):
    """(name, declared size, function that reads) of each file."""
    if form == "gzip":
        yield gunzipped_name(name), 0, lambda: gunzip(data, limits.max_file_bytes)
    elif form == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for m in z.infolist():
                if not m.is_dir():
                    yield m.filename, m.file_size, lambda m=m: z.read(m)
    else:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                if m.isfile():
                    yield m.name, m.size, lambda m=m: t.extractfile(m).read()


def walk(data: bytes, name: str, limits: Limits = Limits(), depth: int = 1, spent: list[int] | None = None) -> list[dict]:
    """The files below an archive. Too large or too deep ones and unsafe paths are reported as skipped; too many files or bytes fail."""
    spent = spent if spent is not None else [0, 0]
    form, out = kind(data), []
    if form is None:
        raise ArchiveError("invalid input: no archive")
    try:
        for member, size, read in _members(data, form, name, limits):
            path = safe_path(member)
            if path is None or size > limits.max_file_bytes:
                out.append({"path": member, "data": None, "status": "skipped", "reason": "unsafe path" if path is None else "too large"})
                continue
            if noise(path):
                continue
            body = read()
            if body is None:
                out.append({"path": path, "data": None, "status": "skipped", "reason": "too large"})
                continue
            spent[1] += len(body)
            if spent[1] > limits.max_total_bytes:
                raise ArchiveError("invalid input: too many bytes when unpacked")
            inner = kind(body)
            if inner and (inner != "zip" or path.lower().endswith(".zip")):
                if depth >= limits.max_depth:
                    out.append({"path": path, "data": None, "status": "skipped", "reason": "nested too deeply"})
                    continue
                below = path if form == "gzip" else posixpath.splitext(path)[0] if inner != "gzip" else posixpath.dirname(path)
                for f in walk(body, posixpath.basename(path), limits, depth + 1, spent):
                    out.append(f | {"path": posixpath.join(posixpath.dirname(path) if inner == "gzip" or form == "gzip" else below, f["path"])})
                continue
            spent[0] += 1
            if spent[0] > limits.max_files:
                raise ArchiveError(f"invalid input: over {limits.max_files} files")
            out.append({"path": path, "data": body, "status": "file", "reason": None})
    except (zipfile.BadZipFile, tarfile.TarError, NotImplementedError) as e:
        raise ArchiveError(f"invalid input: {e}") from None
    return out


def expand(blobs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """filename, path, data, status, reason: a row for each file of each archive."""
    run = F.udf(lambda data, name: walk(bytes(data), name or "data", limits), FILES, useArrow=True)
    return blobs.select("filename", F.inline(run("data", "filename")))


_MADE = T.StructType([T.StructField("files", FILES), T.StructField("error", T.StringType()), T.StructField("ms", T.DoubleType())])


def expanded(blobs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Metered rows: the files of each archive as blobs, named by their path. Skipped files are none of them."""
    own = carried(blobs)

    def make(data, name) -> dict | None:
        if data is None:
            return None
        start = time.perf_counter()
        try:
            files, error = [f for f in walk(bytes(data), name or "data", limits) if f["status"] == "file"], None
        except Exception as e:  # noqa: BLE001  an archive's error is its row's
            files, error = [], said(e)
        return {"files": files, "error": error, "ms": (time.perf_counter() - start) * 1000}

    made = blobs.select(*own, F.col("origin"), F.udf(make, _MADE, useArrow=True)("data", "filename").alias("m"))
    rows = made.select(*own, "origin", F.col("m.error").alias("_error"), F.col("m.ms").alias("_ms"), F.posexplode_outer("m.files").alias("_n", "f"))
    none = F.lit(None).cast("string")
    return rows.select(F.col("f.data").alias("data"), none.alias("mime"), F.col("f.path").alias("filename"), "origin", none.alias("charset"), *own, "_n", "_error", "_ms")
