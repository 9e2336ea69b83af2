"""BLAKE3 (hash mode) after its published specification."""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the specification.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8
_CHUNK, _BLOCK, _M = 1024, 64, 0xFFFFFFFF
#: Chunks worked on together.
_AT_ONCE = 4096
#: Columns, then diagonals.
_LANES = [(i, 4 + i, 8 + i, 12 + i) for i in range(4)] + [(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4) for i in range(4)]


def _compress(value, words, length, low, high, flags) -> tuple:
    """One block, as numbers, or many at once, as arrays of 32-bit numbers; low and high are the counter's halves."""
    v = [*value, *_IV[:4], low, high, length, flags]
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(_LANES):
            for word, near, far in ((words[2 * k], 16, 12), (words[2 * k + 1], 8, 7)):
                v[a] = (v[a] + v[b] + word) & _M
                v[d] = v[d] ^ v[a]
                v[d] = (v[d] >> near | v[d] << 32 - near) & _M
                v[c] = (v[c] + v[d]) & _M
                v[b] = v[b] ^ v[c]
                v[b] = (v[b] >> far | v[b] << 32 - far) & _M
        words = [words[k] for k in _ORDER]
    return tuple(v[k] ^ v[k + 8] for k in range(8))


def _chunk(data: bytes, counter: int, root: int) -> tuple:
    value, blocks = _IV, [data[k : k + _BLOCK] for k in range(0, len(data), _BLOCK)] or [b""]
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1
        words = struct.unpack("<16I", block.ljust(_BLOCK, b"\0"))
        value = _compress(value, words, len(block), counter & _M, counter >> 32, _START * (k == 0) | _END * last | root * last)
    return value


def _whole_chunks(data: memoryview, first: int) -> np.ndarray:
    """The values of whole chunks, one a column, all of them worked on together."""
    words = np.frombuffer(data, "<u4").reshape(-1, _CHUNK // _BLOCK, 16)
    counter, n = np.arange(first, first + len(words)), len(words)
    same = lambda x: np.full(n, x, np.uint32)
    value, ends = tuple(map(same, _IV)), words.shape[1] - 1
    for k in range(ends + 1):
        flags = same(_START * (k == 0) | _END * (k == ends))
        value = _compress(value, words[:, k].T, same(_BLOCK), (counter & _M).astype(np.uint32), (counter >> 32).astype(np.uint32), flags)
    return np.array(value)


def _pairs(nodes: np.ndarray) -> np.ndarray:
    """A level of the tree from the one below it; an odd last node goes up as it is."""
    even = nodes.shape[1] // 2 * 2
    same = lambda x: np.full(even // 2, x, np.uint32)
    words = np.concatenate([nodes[:, :even:2], nodes[:, 1:even:2]])
    above = np.array(_compress(tuple(map(same, _IV)), words, same(_BLOCK), same(0), same(0), same(_PARENT)))
    return np.concatenate([above, nodes[:, even:]], axis=1)


def blake3_hex(data: bytes) -> str:
    whole = max(0, (len(data) - 1) // _CHUNK)  # chunks before the last one
    if not whole:
        return struct.pack("<8I", *_chunk(data, 0, _ROOT)).hex()
    view, parts = memoryview(data), []
    for k in range(0, whole, _AT_ONCE):
        parts.append(_whole_chunks(view[k * _CHUNK : min(whole, k + _AT_ONCE) * _CHUNK], k))
    last = np.array(_chunk(bytes(view[whole * _CHUNK :]), whole, 0), np.uint32)[:, None]
    nodes = np.concatenate([*parts, last], axis=1)
    while nodes.shape[1] > 2:
        nodes = _pairs(nodes)
    return struct.pack("<8I", *_compress(_IV, nodes.T.ravel().tolist(), _BLOCK, 0, 0, _PARENT | _ROOT)).hex()
