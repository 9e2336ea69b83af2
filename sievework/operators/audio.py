"""WAV files: exact durations, windows on frame boundaries, mono resampling; transcription by an injected client."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Callable

import numpy as np


class InvalidInput(ValueError):
    pass


def chunks(data: bytes) -> dict[bytes, tuple[int, int]]:
    """Chunk id -> (start, length), of a RIFF WAVE file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise InvalidInput("invalid input: not a WAV file")
    out, at = {}, 12
    while at + 8 <= len(data):
        n = struct.unpack_from("<I", data, at + 4)[0]
        out.setdefault(data[at : at + 4], (at + 8, min(n, len(data) - at - 8)))
        at += 8 + n + n % 2
    return out


def duration(data: bytes) -> float | None:
    """Seconds by the header; null where it can't tell (compressed audio, no WAV)."""
    try:
        found = chunks(data)
    except InvalidInput:
        return None
    if b"fmt " not in found or b"data" not in found:
        return None
    kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, found[b"fmt "][0])
    frame = channels * (bits // 8)
    return found[b"data"][1] // frame / rate if kind in (1, 3, 0xFFFE) and frame and rate else None


def windows(data: bytes, most_bytes: int) -> list[tuple[float, bytes]]:
    """(start in seconds, WAV file) of pieces of at most so many bytes, cut between frames."""
    with wave.open(io.BytesIO(data)) as w:
        frame, rate = w.getsampwidth() * w.getnchannels(), w.getframerate()
        per, out, at = max(1, (most_bytes - 44) // frame), [], 0
        while body := w.readframes(per):
            made = io.BytesIO()
            with wave.open(made, "wb") as o:
                o.setparams(w.getparams())
                o.writeframes(body)
            out.append((at / rate, made.getvalue()))
            at += len(body) // frame
    return out


def resample(data: bytes, rate: int = 16000, mono: bool = True, max_secs: float | None = None) -> bytes:
    """16-bit PCM at the rate, channels averaged."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, from_rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes() if max_secs is None else int(max_secs * from_rate))
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float64) / float(1 << 8 * width - 1)
    x = x.reshape(-1, channels)
    x = x.mean(axis=1, keepdims=True) if mono else x
    n = int(len(x) * rate / from_rate)
    at = np.arange(n) * from_rate / rate
    y = np.stack([np.interp(at, np.arange(len(x)), x[:, c]) for c in range(x.shape[1])], axis=1) if len(x) else x
    made = io.BytesIO()
    with wave.open(made, "wb") as o:
        o.setnchannels(y.shape[1])
        o.setsampwidth(2)
        o.setframerate(rate)
        o.writeframes(np.clip(np.round(y * 32768), -32768, 32767).astype("<i2").tobytes())
    return made.getvalue()


def usage(seconds: float | None, measured: float | None) -> dict:
    """What a request is metered as: the service's seconds, else the file's; unknown ones count 0, the request always 1."""
    return {"audio_seconds": measured if measured is not None else seconds or 0.0, "external_requests": 1}


def transcribe(data: bytes, client: Callable[[bytes], list[dict]] | None, segment_documents: bool = False, max_bytes: int = 25 << 20) -> list[dict]:
    """client: WAV -> segments of start, end, text. Long files go in windows, whose segments are moved to their place."""
    if client is None:
        raise ValueError("invalid config: no transcription client is set")
    pieces = windows(data, max_bytes) if len(data) > max_bytes else [(0.0, data)]
    found = [s | {"start": s["start"] + at, "end": s["end"] + at} for at, piece in pieces for s in client(piece)]
    if not segment_documents:
        return [{"content": " ".join(s["text"].strip() for s in found)}]
    return [{"suffix": f"_t{n}", "content": s["text"].strip(), "fields": f'{{"end":{s["end"]},"start":{s["start"]}}}'} for n, s in enumerate(found)]
