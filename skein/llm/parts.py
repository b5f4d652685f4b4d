"""Compact payloads for rows that carry many small values through a shuffle."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def pack_parts(*parts: bytes, level: int = 3) -> bytes:
    """Byte strings in one compressed payload."""
    head = struct.pack(f"<{len(parts) + 1}I", len(parts), *map(len, parts))
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(parts))


def unpack_parts(payload: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    (n,) = struct.unpack_from("<I", raw)
    sizes = struct.unpack_from(f"<{n}I", raw, 4)
    at, out = 4 * (n + 1), []
    for size in sizes:
        out.append(raw[at : at + size])
        at += size
    return out


def planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers by byte planes, which compress better than whole integers."""
    return np.ascontiguousarray(values.astype("<u4").view("u1").reshape(-1, 4).T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, "u1").reshape(4, -1).T).view("<u4").ravel()
