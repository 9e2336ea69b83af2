"""The URL source: one file fetched for each source, if it changed since the last time."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from datetime import datetime
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.blake3 import blake3_hex
from .url import TemplateError, host_allowed, render

# Redirects followed and bytes taken at most.
MOST_REDIRECTS, MOST_BYTES = 5, 512 << 20
#: (method, url, headers) -> status, headers (lower-case names), the body's pieces.
Client = Callable[[str, str, dict], tuple[int, dict, Iterable[bytes]]]
FETCHED = "source_id string, outcome string, error string, transient boolean, data binary, mime string, filename string, origin string, charset string, etag string, last_modified string, hash string"

_COLUMNS = [c.split()[0] for c in FETCHED.split(", ")]
#: Bytes of bodies that a task holds before it hands them on.
_HELD = 8 << 20


class FetchError(Exception):
    def __init__(self, message: str, transient: bool = False):
        super().__init__(message)
        self.transient = transient


def _origin(url: str) -> tuple:
    parts = urlsplit(url)
    return parts.scheme, parts.hostname, parts.port or {"http": 80, "https": 443}.get(parts.scheme)


def _answer(client: Client, url: str, wanted: dict, credentials: dict, allowed: list[str] | None) -> tuple[int, dict, Iterable[bytes]]:
    """The answer behind all redirects; every host on the way is checked, and credentials go to the source's own origin alone."""
    current = url
    for _ in range(MOST_REDIRECTS + 1):
        parts = urlsplit(current)
        if parts.scheme not in ("http", "https") or not host_allowed(parts.hostname or "", allowed):
            raise FetchError(f"{current}: the host is not allowed")
        own = credentials if _origin(current) == _origin(url) else {}
        status, headers, body = client("GET", current, {**wanted, **own})
        if not 300 <= status < 400 or status == 304:
            return status, headers, body
        if "location" not in headers:
            raise FetchError(f"{current}: {status} without a Location header", transient=True)
        current = urljoin(current, headers["location"])
    raise FetchError(f"{url}: more than {MOST_REDIRECTS} redirects", transient=True)


def _body(pieces: Iterable[bytes], url: str, most: int) -> bytes:
    data = bytearray()
    for piece in pieces:
        if len(data) + len(piece) > most:  # before the rest is read
            raise FetchError(f"GET {url}: body exceeds the {most} byte cap")
        data += piece
    return bytes(data)


def fetch_one(client: Client, template: str, scheduled_at: datetime, timezone: str = "UTC", state: dict | None = None, headers: dict | None = None, credentials: dict | None = None, allowed: list[str] | None = None, most: int = MOST_BYTES) -> dict:
    """The columns of FETCHED behind source_id. outcome: items, unchanged (304, or a body with the stored hash) or failed."""
    from ..operators.archives import gunzip

    state, out = state or {}, dict.fromkeys(("error", "transient", "data", "mime", "filename", "origin", "charset", "etag", "last_modified", "hash"))
    try:
        url = render(template, scheduled_at, timezone or "UTC")
        known = {"if-none-match": state.get("etag"), "if-modified-since": state.get("last_modified")}
        status, got, pieces = _answer(client, url, {**(headers or {}), **{k: v for k, v in known.items() if v}}, credentials or {}, allowed)
        if status == 304:
            return out | {"outcome": "unchanged"}
        if not 200 <= status < 300:
            raise FetchError(f"GET {url}: status {status}", transient=not 400 <= status < 500 or status in (408, 429))
        data = _body(pieces, url, most)
        hash_ = blake3_hex(data)
        if hash_ == state.get("hash"):
            return out | {"outcome": "unchanged"}
        name = unquote(urlsplit(url).path.rsplit("/", 1)[-1]) or None
        if data[:2] == b"\x1f\x8b":
            data, name = gunzip(data, most), name and re.sub(r"(?i)\.gz$", "", name)
        kind = got.get("content-type") or ""
        mime = kind.split(";")[0].strip().lower()
        charset = re.search(r";\s*charset\s*=\s*\"?([^\";\s]+)", kind, re.I)
        return out | {"outcome": "items", "data": data, "mime": None if mime in ("", "application/octet-stream") else mime, "filename": name, "origin": url, "charset": charset and charset[1], "etag": got.get("etag"), "last_modified": got.get("last-modified"), "hash": hash_}
    except FetchError as e:
        return out | {"outcome": "failed", "error": str(e), "transient": e.transient}
    except (TemplateError, ValueError) as e:  # a template, a URL or a gzip stream that cannot be read fails alike each time
        return out | {"outcome": "failed", "error": f"{template}: {e}", "transient": False}


def resolve(sources: DataFrame, client: Client, scheduled_at: datetime, allowed: list[str] | None = None, most: int = MOST_BYTES) -> DataFrame:
    """sources: source_id, url (a template), and where there are any timezone, headers and credentials (maps), etag, last_modified, hash.

    One row of FETCHED for each source. mime is null where the server does not tell; content types are then found by the
    data. Fetching happens in the tasks, a source at a time; a task holds one body or some small ones. The state only moves when
    url.commit() is given the rows of jobs that all went well.
    """

    def run(batches):
        held, size = [], 0
        for frame in batches:
            for row in frame.to_dict("records"):
                told = {c: v if isinstance(v := row.get(c), str) else None for c in ("timezone", "etag", "last_modified", "hash")}  # noqa: B023
                zone = told.pop("timezone") or "UTC"
                got = fetch_one(client, row["url"], scheduled_at, zone, told, dict(row.get("headers") or {}), dict(row.get("credentials") or {}), allowed, most)
                held.append({"source_id": str(row["source_id"]), **got})
                size += len(got["data"] or b"") + 1024
                if size > _HELD:
                    yield pd.DataFrame(held)[_COLUMNS]
                    held, size = [], 0
        if held:
            yield pd.DataFrame(held)[_COLUMNS]

    return sources.mapInPandas(run, FETCHED)
