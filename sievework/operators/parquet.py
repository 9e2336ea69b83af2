"""Parquet files to documents: one for each row, typed by the file's own schema."""

from __future__ import annotations

import io
import math
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from . import json_records
from .json_records import FlattenConfig, InvalidInput, decoded_size, document

# Decimals of more digits are exact strings; rows in a batch, and at most.
NUMERIC_DIGITS, BATCH_ROWS, MOST_BATCH_ROWS = 15, 1024, 8192
NODE_BYTES = 32


def _clock(seconds: int, nanos: int) -> str:
    """hh:mm:ss with 3, 6 or 9 further digits where there are any."""
    digits = f"{nanos:09d}"
    part = "" if not nanos else f".{digits[:3]}" if not nanos % 1_000_000 else f".{digits[:6]}" if not nanos % 1000 else f".{digits}"
    return f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}{part}"


def _moment(x: int, unit: int, zone: str | None) -> str:
    seconds, rest = divmod(x, unit)
    end = "Z" if zone else ""
    if zone not in (None, "UTC", "Z", "+00:00"):
        at = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=seconds)
        local = at.astimezone(timezone(timedelta(minutes=int(zone[:1] + "1") * (int(zone[1:3]) * 60 + int(zone[-2:])))) if zone[0] in "+-" else ZoneInfo(zone))
        shift = int(local.utcoffset().total_seconds())
        seconds, sign = seconds + shift, "-" if shift < 0 else "+"
        end = f"{sign}{abs(shift) // 3600:02d}:{abs(shift) // 60 % 60:02d}" if shift else "Z"
    day, clock = divmod(seconds, 86400)
    return f"{np.datetime64(int(day), 'D')}T{_clock(int(clock), rest * (10**9 // unit))}{end}"


_UNITS = {"s": 1, "ms": 10**3, "us": 10**6, "ns": 10**9}


def json_values(a: pa.Array) -> list:
    """Each value as JSON has it. Null is None; objects leave null out."""
    t = a.type
    kind = pa.types
    each = lambda f, x: [None if v is None else f(v) for v in x.to_pylist()]
    if kind.is_dictionary(t):
        return json_values(a.dictionary_decode())
    if kind.is_null(t) or kind.is_boolean(t) or kind.is_integer(t) or kind.is_string(t) or kind.is_large_string(t) or kind.is_string_view(t):
        return a.to_pylist()
    if kind.is_floating(t):
        short = np.float64 if t.bit_width == 64 else np.dtype(f"f{t.bit_width // 8}").type
        return each(lambda x: float(str(short(x))) if math.isfinite(x) else None, a)
    if kind.is_decimal(t):
        if t.precision > NUMERIC_DIGITS:
            return each(lambda x: f"{x:f}", a)
        return each(lambda x: int(x) if t.scale <= 0 else float(x), a)
    if kind.is_date32(t):
        return each(lambda x: str(np.datetime64(x, "D")), a.cast(pa.int32()))
    if kind.is_date64(t):
        return each(lambda x: f"{x.isoformat()}T00:00:00", a)
    if kind.is_timestamp(t):
        return each(lambda x: _moment(x, _UNITS[t.unit], t.tz), a.cast(pa.int64()))
    if kind.is_time(t):
        unit = _UNITS[t.unit]
        return each(lambda x: _clock(x // unit, x % unit * (10**9 // unit)), a.cast(pa.int32() if kind.is_time32(t) else pa.int64()))
    if kind.is_binary(t) or kind.is_large_binary(t) or kind.is_fixed_size_binary(t) or kind.is_binary_view(t):
        return each(bytes.hex, a)
    if kind.is_struct(t):
        columns = [(t.field(k).name, c.is_valid().to_pylist(), json_values(c)) for k, c in enumerate(a.flatten())]
        return [{name: v[i] for name, ok, v in columns if ok[i]} if given else None for i, given in enumerate(a.is_valid().to_pylist())]
    if kind.is_map(t):
        keys, items, ok, at = json_values(a.keys), json_values(a.items), a.items.is_valid().to_pylist(), a.offsets.to_pylist()
        return [{str(keys[k]): items[k] for k in range(at[i], at[i + 1]) if ok[k]} if given else None for i, given in enumerate(a.is_valid().to_pylist())]
    if kind.is_list(t) or kind.is_large_list(t) or kind.is_fixed_size_list(t):
        items, out, at = json_values(a.flatten()), [], 0
        for n in a.value_lengths().to_pylist() if not kind.is_fixed_size_list(t) else [t.list_size if x else None for x in a.is_valid().to_pylist()]:
            out.append(None if n is None else items[at : at + n])
            at += n or 0
        return out
    raise InvalidInput(f"invalid input: column type {t} is not supported")


def _over() -> InvalidInput:
    return InvalidInput(f"invalid input: over {json_records.MAX_ROWS} records or {json_records.MAX_BYTES} bytes; nothing is cut off")


def parquet_records(data: bytes, columns: list[str] | None = None, max_rows: int | None = None, batch_size: int = BATCH_ROWS) -> list[dict]:
    """The rows of a file, null cells left out; columns names those to read (a struct by its own name or its parts' paths)."""
    if (max_rows is not None and max_rows < 1) or batch_size < 1 or (columns is not None and not columns):
        raise ValueError("invalid config: max_rows and batch_size must be 1 or more and columns, when set, not empty")
    if len(data) < 8 or not (data.startswith(b"PAR1") and data.endswith(b"PAR1")):
        raise InvalidInput("invalid input: not a Parquet file (missing PAR1 marker)")
    try:
        file = pq.ParquetFile(io.BytesIO(data))
        leaves = [file.schema.column(k) for k in range(len(file.schema.names))]
        chosen = [k for k, x in enumerate(leaves) if columns is None or any(x.path == c or x.path.startswith(f"{c}.") for c in columns)]
        for c in columns or []:
            if not any(x.path == c or x.path.startswith(f"{c}.") for x in leaves):
                raise ValueError(f"invalid config: columns refers to unknown column {c!r} (available: {[x.path for x in leaves]})")
        rows = levels = 0
        for g in range(file.metadata.num_row_groups):
            if max_rows is not None and rows >= max_rows:
                break
            group = file.metadata.row_group(g)
            rows += group.num_rows
            levels += sum(group.column(k).num_values for k in chosen if leaves[k].max_repetition_level)
        if min(rows, max_rows or rows) > json_records.MAX_ROWS or levels * NODE_BYTES > json_records.MAX_BYTES:
            raise _over()
        out, size = [], 0
        for batch in file.iter_batches(min(batch_size, MOST_BATCH_ROWS), columns=None if columns is None else [leaves[k].path for k in chosen]):
            if max_rows is not None:
                batch = batch.slice(0, max_rows - len(out))
            made = json_values(batch.to_struct_array())
            out += made
            size += sum(map(decoded_size, made))
            if len(out) > json_records.MAX_ROWS or size > json_records.MAX_BYTES:
                raise _over()
            if len(out) == max_rows:
                break
        return out
    except (pa.ArrowException, OSError) as e:
        raise InvalidInput(f"invalid input: unreadable Parquet: {e}") from None


def parquet_documents(data: bytes, columns: list[str] | None = None, max_rows: int | None = None, batch_size: int = BATCH_ROWS, **flatten) -> list[dict]:
    config = FlattenConfig(**flatten)
    made = [document(r, f"_r{k}", config) for k, r in enumerate(parquet_records(data, columns, max_rows, batch_size), 1)]
    return [{"id": d["id"], "suffix": d["generated"], "title": d["title"], "content": d["content"], "fields": d["fields"]} for d in made]
