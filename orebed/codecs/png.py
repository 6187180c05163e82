"""PNG files of RGBA8 arrays: a writer, and a reader for what the writer makes and other 8-bit RGB(A) files."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = bytes.fromhex("89504E470D0A1A0A")


def zlib_level(level: int) -> int:
    """0 to 2 is fast, 3 to 6 usual, 7 and more best."""
    return 1 if level <= 2 else 6 if level <= 6 else 9


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(image: np.ndarray, level: int = 6) -> bytes:
    height, width = image.shape[:2]
    rows = np.zeros((height, width * 4 + 1), np.uint8)
    rows[:, 1:] = image.reshape(height, width * 4)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">2I5B", width, height, 8, 6, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), zlib_level(level))) + _chunk(b"IEND", b"")


def size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header."""
    return struct.unpack_from(">2I", data, 16) if data[:8] == SIGNATURE and len(data) >= 24 else None


def decode(data: bytes) -> np.ndarray:
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, body, head = 8, b"", None
    while at + 8 <= len(data):
        length, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + length]
        head = part if kind == b"IHDR" else head
        body += part if kind == b"IDAT" else b""
        at += 12 + length
    if head is None:
        raise ValueError("no header")
    width, height, depth, colour, _, _, interlace = struct.unpack(">2I5B", head)
    if depth != 8 or colour not in (2, 6) or interlace:
        raise ValueError("only 8-bit RGB and RGBA are read")
    n = 4 if colour == 6 else 3
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width * n + 1)
    out = np.zeros((height, width * n), np.uint8)
    above = np.zeros(width * n, np.uint8)
    for y in range(height):
        out[y] = above = _unfiltered(rows[y, 0], rows[y, 1:], above, n)
    pixels = out.reshape(height, width, n)
    return pixels if n == 4 else np.dstack([pixels, np.full((height, width), 255, np.uint8)])


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    if kind == 0:
        return row.copy()
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, n), axis=0, dtype=np.uint8).reshape(-1)
    out = np.zeros(len(row) + n, np.int64)
    up = np.concatenate([np.zeros(n, np.int64), above])
    for i in range(n, len(out)):
        a, b, c = out[i - n], up[i], up[i - n]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i] = (row[i - n] + guess) & 255
    return out[n:].astype(np.uint8)
