"""Palettised run-length sprites: header, frame table, line table, runs."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from orebed.codecs import palette as palettes

# Limits and opcodes of the format.
MAX_FRAMES, MAX_SIDE = 1000, 2048
SKIP, REPEAT = 0x80, 0x40
#: Up to so many lines, decoding each for itself is faster than all together.
FEW_LINES = 96


@dataclass(frozen=True)
class Sprite:
    width: int
    height: int
    frames: list[np.ndarray]  # of indices, height x width

    def frame(self, n: int = 0) -> np.ndarray | None:
        return self.frames[n] if 0 <= n < len(self.frames) else None


def frame_table(data: bytes) -> tuple[int, int, list[int]]:
    """Width, height and the frames' offsets."""
    if len(data) < 6:
        raise ValueError("shorter than a header")
    count, width, height = struct.unpack_from("<3H", data)
    if not (0 < count <= MAX_FRAMES and 0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ValueError(f"{count} frames of {width} x {height}")
    if len(data) < 6 + 8 * count:
        raise ValueError("the frame table is cut short")
    offsets = [struct.unpack_from("<I", data, 6 + 8 * i + 4)[0] for i in range(count)]
    if any(o >= len(data) for o in offsets):
        raise ValueError("a frame lies beyond the end")
    return width, height, offsets


def frame_end(offsets: list[int], i: int, size: int) -> int:
    """The first later frame, in index order, that lies further on; else the end."""
    return next((o for o in offsets[i + 1 :] if o > offsets[i]), size)


def line(runs: bytes, width: int) -> np.ndarray:
    """One row of indices; runs beyond the width are cut."""
    out = bytearray(width)
    x = i = 0
    while i < len(runs) and x < width:
        op = runs[i]
        i += 1
        if op >= SKIP:
            x += op - SKIP
        elif op > REPEAT:
            if i >= len(runs):
                break
            size = min(op - REPEAT, width - x)
            out[x : x + size] = runs[i : i + 1] * size
            x, i = x + size, i + 1
        else:
            got = runs[i : i + min(op, width - x)]
            out[x : x + len(got)] = got
            x, i = x + op, i + op
    return np.frombuffer(out, np.uint8)


def lines(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Many rows of indices at once: row i's runs lie between starts[i] and ends[i] of the bytes. As `line` does for each.

    The rows advance together, an opcode of each in every step; what the opcodes fill is gathered once at the end.
    """
    out = np.zeros((len(starts), width), np.uint8)
    row, at, end = np.arange(len(starts)), starts.astype(np.int64), ends.astype(np.int64)
    x = np.zeros(len(starts), np.int64)
    spans: list[tuple[np.ndarray, ...]] = []  # place in out, length, place in data, step in data
    while True:
        going = (at < end) & (x < width)
        if not going.all():
            row, at, end, x = row[going], at[going], end[going], x[going]
        if not len(row):
            break
        op = data[at].astype(np.int64)
        at = at + 1
        skip, again = op >= SKIP, (op > REPEAT) & (op < SKIP)
        length = np.where(skip, op - SKIP, np.where(again, op - REPEAT, op))
        cut = again & (at >= end)
        given = np.where(again, length, np.where(skip, 0, np.minimum(length, end - at)))
        given = np.where(cut, 0, np.minimum(given, width - x))
        some = given > 0
        if some.any():
            spans.append((row[some] * width + x[some], given[some], at[some], (~again[some]).astype(np.int64)))
        x = np.where(cut, width, x + length)
        at = at + np.where(again, 1, np.where(skip, 0, length))
    if spans:
        to, size, source, step = (np.concatenate(c) for c in zip(*spans))
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out.reshape(-1)[np.repeat(to, size) + within] = data[np.repeat(source, size) + within * np.repeat(step, size)]
    return out


def parse(data: bytes) -> Sprite:
    """All frames; bad or missing lines stay zero. Many lines are decoded together, few ones each for itself."""
    width, height, offsets = frame_table(data)
    raw = np.frombuffer(data, np.uint8)
    rows, starts, ends = [], [], []
    for i, offset in enumerate(offsets):
        size = frame_end(offsets, i, len(data)) - offset
        if size < 2:
            continue
        count = min(int.from_bytes(data[offset : offset + 2], "little") // 2, height, size // 2)
        table = np.frombuffer(data, "<u2", count, offset).astype(np.int64)
        following = np.append(table[1:], size)[: len(table)]
        good = table < size
        rows.append(np.flatnonzero(good) + i * height)
        starts.append(offset + table[good])
        ends.append(offset + np.where((table < following) & (following <= size), following, size)[good])
    out = np.zeros((len(offsets) * height, width), np.uint8)
    if rows:
        at, starts, ends = map(np.concatenate, (rows, starts, ends))
        if len(at) <= FEW_LINES:
            for i, a, b in zip(at.tolist(), starts.tolist(), ends.tolist()):
                out[i] = line(data[a:b], width)
        else:
            out[at] = lines(raw, starts, ends, width)
    return Sprite(width, height, list(out.reshape(len(offsets), height, width)))


def rgba(indices: np.ndarray, palette: np.ndarray | None = None, transparent_zero: bool = False) -> np.ndarray:
    """Pixels of a frame, grey without a palette."""
    return palettes.looked_up(indices, palettes.grey(False) if palette is None else palette, 0 if transparent_zero else None)
