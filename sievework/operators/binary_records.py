"""MessagePack and Avro object container files to JSON values."""

from __future__ import annotations

import base64
import datetime
import json
import math
import struct
import zlib
from decimal import Decimal

from .json_records import FlattenConfig, InvalidInput, check_limits, document, dumps, free_name, roots


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise InvalidInput("invalid input: the data end early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, code: str):
        return struct.unpack(code, self.take(struct.calcsize(code)))[0]

    @property
    def done(self) -> bool:
        return self.at >= len(self.data)


def encoded(data: bytes) -> str:
    return base64.b64encode(data).decode()


def finite(x: float) -> float | None:
    return x if math.isfinite(x) else None


def rfc3339(seconds: int, nanos: int = 0) -> str:
    whole = (datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=seconds)).isoformat()
    return f"{whole}{f'.{nanos:09d}'.rstrip('0') if nanos else ''}Z"


# MessagePack: the formats of its specification, by first byte.
_SIZED = {0xC4: ">B", 0xC5: ">H", 0xC6: ">I", 0xC7: ">B", 0xC8: ">H", 0xC9: ">I", 0xD9: ">B", 0xDA: ">H", 0xDB: ">I", 0xDC: ">H", 0xDD: ">I", 0xDE: ">H", 0xDF: ">I"}
_NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}


def _extension(kind: int, data: bytes):
    if kind == -1 and len(data) == 4:
        return rfc3339(struct.unpack(">I", data)[0])
    if kind == -1 and len(data) == 8:
        both = struct.unpack(">Q", data)[0]
        return rfc3339(both & (1 << 34) - 1, both >> 34)
    if kind == -1 and len(data) == 12:
        nanos, seconds = struct.unpack(">Iq", data)
        return rfc3339(seconds, nanos)
    return encoded(data)


def msgpack_value(r: Reader, depth: int = 0):
    if depth > 256:
        raise InvalidInput("invalid input: nested too deeply")
    first = r.number(">B")
    if first < 0x80 or first >= 0xE0:
        return first if first < 0x80 else first - 256
    if first in _NUMBERS:
        n = r.number(_NUMBERS[first])
        return finite(n) if isinstance(n, float) else n
    if first in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[first]
    if 0xD4 <= first <= 0xD8:
        return _extension(r.number(">b"), r.take(1 << first - 0xD4))
    if first == 0xC1:
        raise InvalidInput("invalid input: byte c1")
    n = r.number(_SIZED[first]) if first in _SIZED else first & (0x1F if 0xA0 <= first < 0xC0 else 0x0F)
    if 0xC4 <= first <= 0xC6:
        return encoded(r.take(n))
    if 0xC7 <= first <= 0xC9:
        kind = r.number(">b")
        return _extension(kind, r.take(n))
    if 0xA0 <= first < 0xC0 or 0xD9 <= first <= 0xDB:
        return r.take(n).decode("utf-8", "replace")
    if 0x90 <= first < 0xA0 or first in (0xDC, 0xDD):
        return [msgpack_value(r, depth + 1) for _ in range(n)]
    out: dict = {}
    for _ in range(n):
        key = msgpack_value(r, depth + 1)
        out[free_name(out, key if isinstance(key, str) else dumps(key))] = msgpack_value(r, depth + 1)
    return out


def msgpack_records(data: bytes) -> list:
    """One value's records; values behind one another are a record each."""
    r, values = Reader(data), []
    while not r.done:
        values.append(msgpack_value(r))
    return roots(values[0]) if len(values) == 1 else values


# Avro: the binary encoding of its specification.


def _long(r: Reader) -> int:
    n = shift = 0
    while True:
        b = r.number("B")
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n >> 1 ^ -(n & 1)
        shift += 7


def _bytes(r: Reader) -> bytes:
    return r.take(_long(r))


def format_scaled(unscaled: int, scale: int) -> str:
    return str(Decimal(unscaled).scaleb(-scale)) if scale <= 0 else f"{'-' * (unscaled < 0)}{abs(unscaled) // 10**scale}.{abs(unscaled) % 10**scale:0{scale}d}"


def _clock(seconds: int, rest: int, digits: int) -> str:
    return f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}.{rest:0{digits}d}"


_UNITS = {"millis": (1000, 3), "micros": (10**6, 6), "nanos": (10**9, 9)}


def _logical(schema: dict, value):
    kind = schema.get("logicalType", "")
    if kind == "decimal" and isinstance(value, bytes):
        return format_scaled(int.from_bytes(value, "big", signed=True), schema.get("scale", 0)) if len(value) <= 16 else encoded(value)
    if kind == "date" and isinstance(value, int):
        return (datetime.date(1970, 1, 1) + datetime.timedelta(days=value)).isoformat()
    if kind == "duration" and isinstance(value, bytes):
        return dict(zip(("months", "days", "millis"), struct.unpack("<3I", value), strict=True))
    base, _, unit = kind.rpartition("-")
    if unit in _UNITS and isinstance(value, int):
        per, digits = _UNITS[unit]
        seconds, rest = divmod(value, per)
        if base == "time":
            return _clock(seconds, rest, digits)
        if base in ("timestamp", "local-timestamp"):
            whole = rfc3339(seconds, rest * 10 ** (9 - digits))
            return whole if base == "timestamp" else whole[:-1]
    return value


def _shown(value):
    return encoded(value) if isinstance(value, bytes) else value


def avro_value(r: Reader, schema, names: dict):
    if isinstance(schema, list):
        return avro_value(r, schema[_long(r)], names)
    if isinstance(schema, str):
        if schema in names:
            return avro_value(r, names[schema], names)
        schema = {"type": schema}
    kind = schema["type"]
    if isinstance(kind, dict | list) or kind in names:
        return avro_value(r, kind, names)
    if kind in ("record", "error"):
        return {f["name"]: avro_value(r, f["type"], names) for f in schema["fields"]}
    if kind in ("array", "map"):
        items: list = []
        while n := _long(r):
            if n < 0:
                n = -n
                _long(r)
            for _ in range(n):
                key = _bytes(r).decode() if kind == "map" else None
                items.append((key, avro_value(r, schema["items" if kind == "array" else "values"], names)))
        return dict(items) if kind == "map" else [v for _, v in items]
    if kind == "enum":
        return schema["symbols"][_long(r)]
    plain = {"null": lambda: None, "boolean": lambda: r.number("B") == 1, "int": lambda: _long(r), "long": lambda: _long(r), "float": lambda: finite(r.number("<f")), "double": lambda: finite(r.number("<d")), "bytes": lambda: _bytes(r), "string": lambda: _bytes(r).decode(), "fixed": lambda: r.take(schema["size"])}
    if kind not in plain:
        raise InvalidInput(f"invalid input: unknown type {kind}")
    return _shown(_logical(schema, plain[kind]()))


def _named(schema, names: dict) -> dict:
    if isinstance(schema, list):
        for s in schema:
            _named(s, names)
    elif isinstance(schema, dict):
        if "name" in schema:
            names[schema["name"]] = schema
            if schema.get("namespace"):
                names[f"{schema['namespace']}.{schema['name']}"] = schema
        for part in (schema.get("items"), schema.get("values"), schema.get("type"), *(f["type"] for f in schema.get("fields", []))):
            if isinstance(part, dict | list):
                _named(part, names)
    return names


def snappy(data: bytes) -> bytes:
    """The raw Snappy format."""
    r, out = Reader(data), bytearray()
    while r.number("B") & 0x80:
        pass
    while not r.done:
        tag = r.number("B")
        n = tag >> 2
        if tag & 3 == 0:
            if n >= 60:
                n = int.from_bytes(r.take(n - 59), "little")
            out += r.take(n + 1)
            continue
        size, back = (n % 8 + 4, (tag >> 5) << 8 | r.number("B")) if tag & 3 == 1 else (n + 1, r.number("<H" if tag & 3 == 2 else "<I"))
        for _ in range(size):
            out.append(out[-back])
    return bytes(out)


def _unpack(codec: str, block: bytes) -> bytes:
    if codec == "deflate":
        return zlib.decompress(block, -15)
    if codec == "snappy":
        return snappy(block[:-4])
    if codec == "zstandard":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(block)
    if codec in ("null", ""):
        return block
    raise InvalidInput(f"invalid input: codec {codec}")


def avro_records(data: bytes) -> list:
    if not data.startswith(b"Obj\x01"):
        raise InvalidInput("invalid input: not an Avro object container file")
    r, meta = Reader(data[4:]), {}
    while n := _long(r):
        if n < 0:
            n = -n
            _long(r)
        for _ in range(n):
            key = _bytes(r).decode()
            meta[key] = _bytes(r)
    schema, sync, out = json.loads(meta["avro.schema"]), r.take(16), []
    names = _named(schema, {})
    while not r.done:
        n = _long(r)
        block = Reader(_unpack(meta.get("avro.codec", b"null").decode(), _bytes(r)))
        out += [avro_value(block, schema, names) for _ in range(n)]
        if r.take(16) != sync:
            raise InvalidInput("invalid input: a block does not end with the file's mark")
    return out


def _documents(records: list, suffix: str, first: int, most: int | None) -> list[dict]:
    made = [document(x, f"{suffix}{k}", FlattenConfig()) for k, x in enumerate(check_limits(records)[:most], first)]
    return [{"suffix": d["generated"], "title": d["title"], "content": d["content"], "fields": d["fields"]} for d in made]


def msgpack_documents(data: bytes, max_records: int | None = None) -> list[dict]:
    return _documents(msgpack_records(data), "_", 0, max_records)


def avro_documents(data: bytes, max_records: int | None = None) -> list[dict]:
    return _documents(avro_records(data), "_r", 1, max_records)
