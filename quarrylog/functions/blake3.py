"""BLAKE3 key derivation for short inputs, after the published algorithm; no wheel is needed."""

from __future__ import annotations

import struct
from functools import lru_cache

# Fixed values of the algorithm: the initial words and the message permutation.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT, CONTEXT, MATERIAL = 1, 2, 4, 8, 32, 64
_MASK = 0xFFFFFFFF


def _mix(v, a, b, c, d, x, y):
    for m, r1, r2 in ((x, 16, 12), (y, 8, 7)):
        v[a] = (v[a] + v[b] + m) & _MASK
        t = v[d] ^ v[a]
        v[d] = ((t >> r1) | (t << (32 - r1))) & _MASK
        v[c] = (v[c] + v[d]) & _MASK
        t = v[b] ^ v[c]
        v[b] = ((t >> r2) | (t << (32 - r2))) & _MASK


def _compress(cv, block: bytes, counter: int, length: int, flags: int):
    m = list(struct.unpack("<16I", block.ljust(64, b"\0")))
    v = [*cv, *IV[:4], counter & _MASK, counter >> 32, length, flags]
    for r in range(7):
        for i in range(4):
            _mix(v, i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
        for i in range(4):
            _mix(v, i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        if r < 6:
            m = [m[p] for p in PERMUTATION]
    return [v[i] ^ v[i + 8] for i in range(8)]


def _chunk(key, data: bytes, counter: int, flags: int, root: bool):
    cv, blocks = key, [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
    for i, b in enumerate(blocks):
        f = flags | (CHUNK_START if i == 0 else 0) | ((CHUNK_END | (ROOT if root else 0)) if i == len(blocks) - 1 else 0)
        cv = _compress(cv, b, counter, len(b), f)
    return cv


def _tree(key, data: bytes, flags: int, first: int = 0, root: bool = True):
    if len(data) <= 1024:
        return _chunk(key, data, first, flags, root)
    left = 1024
    while 2 * left < len(data):
        left *= 2
    words = _tree(key, data[:left], flags, first, False) + _tree(key, data[left:], flags, first + left // 1024, False)
    return _compress(key, struct.pack("<16I", *words), 0, 64, flags | PARENT | (ROOT if root else 0))


@lru_cache(16)
def _context_key(context: str):
    return _tree(IV, context.encode(), CONTEXT)


@lru_cache(65_536)
def derive(context: str, material: bytes) -> bytes:
    """The 32-byte derived key; equal faults come often, so answers are remembered."""
    return struct.pack("<8I", *_tree(_context_key(context), material, MATERIAL))
