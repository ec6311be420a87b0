"""Compressed packs of arrays, for what goes through a shuffle."""

from __future__ import annotations

import numpy as np

LEVEL = 3


def squeeze(*arrays: np.ndarray) -> bytes:
    import zstandard as zstd

    raw = b"".join(len(a).to_bytes(8, "little") + a.dtype.str.encode().ljust(4) + a.tobytes() for a in arrays)
    return zstd.ZstdCompressor(level=LEVEL).compress(raw)


def expand(data: bytes) -> list[np.ndarray]:
    import zstandard as zstd

    raw, at, out = zstd.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        n, kind = int.from_bytes(raw[at:at + 8], "little"), np.dtype(raw[at + 8:at + 12].decode().strip())
        out.append(np.frombuffer(raw, kind, n, at + 12))
        at += 12 + n * kind.itemsize
    return out


def small(a: np.ndarray) -> np.ndarray:
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
