"""Bytes of the formats, built for tests."""

import struct

import numpy as np


def grp(frames, width, height):
    """frames: arrays of indices; zeros at least two long are skips, other runs repeats, the rest literals."""
    head = struct.pack("<3H", len(frames), width, height)
    at, table, bodies = len(head) + 8 * len(frames), b"", b""
    for f in frames:
        lines = [_line(row) for row in np.asarray(f, np.uint8).reshape(height, width)]
        starts, pos = [], 2 * height
        for x in lines:
            starts.append(pos)
            pos += len(x)
        body = struct.pack(f"<{height}H", *starts) + b"".join(lines)
        table += struct.pack("<BBHI", 0, 0, 0, at + len(bodies))
        bodies += body
    return head + table + bodies


def _line(row):
    out, i, row = b"", 0, row.tolist()
    while i < len(row):
        n = 1
        while i + n < len(row) and row[i + n] == row[i] and n < 63:
            n += 1
        if row[i] == 0:
            out += bytes([0x80 + n])
        elif n > 1:
            out += bytes([0x40 + n, row[i]])
        else:
            out += bytes([1, row[i]])
        i += n
    return out


def index(entries, mark=7, offset_bytes=4, bucket=5, key_bytes=9):
    out = struct.pack("<II3H", 16, 0, mark, 0, 0)[:10] + bytes([bucket, 0, 4, offset_bytes, key_bytes, 24]) + struct.pack("<Q", 0)
    for key, data_file, offset in entries:
        out += key + struct.pack("<I", data_file) + offset.to_bytes(offset_bytes, "little")
    return out


def names(*given):
    return b"".join(n.encode().ljust(32, b"\0") for n in [*given, *[""] * (10 - len(given))])


def layered(layers, frames, version=0x0202, size=(64, 32)):
    """layers: (name, width, height, data)."""
    head = b"ANIM" + struct.pack("<4H", version, 0, len(layers), 1) + names(*(x[0] for x in layers))
    pointer = len(head) + 12 + 120
    at, table, blobs = pointer + 16 * len(frames), b"", b""
    for _, w, h, data in layers:
        table += struct.pack("<IIHH", at + len(blobs) if data else 0, len(data), w, h)
        blobs += data
    table = table.ljust(120, b"\0")
    return head + struct.pack("<4HI", len(frames), 0, *size, pointer) + table + b"".join(struct.pack("<HHhhHHHH", *f, 0, 0) for f in frames) + blobs


def standard(sprites):
    """sprites: (frames of one or two layer entries each, layer data)."""
    head = b"ANIM" + struct.pack("<4H", 0x0101, 0, 2, len(sprites)) + names("diffuse", "teamcolor")
    at, offsets, bodies = 332 + 4 * len(sprites), b"", b""
    for frames, data in sprites:
        here = at + len(bodies)
        table = here + 36
        first = table + 16 * sum(map(len, frames))
        second = first + len(data[0]) if len(data) > 1 else 0
        body = struct.pack("<HHIIIIHHIIHH", len(frames), 0xFFFF, 0, table, first, len(data[0]), 8, 4, second, len(data[1]) if second else 0, 8, 4)
        body += b"".join(struct.pack("<HHhhHHHH", *p, 0, 0) for f in frames for p in f) + b"".join(data)
        offsets += struct.pack("<I", here)
        bodies += body
    return head + offsets + bodies


def dds(kind, width, height, body):
    head = bytearray(128)
    head[:4] = b"DDS "
    struct.pack_into("<2I", head, 12, height, width)
    head[84:88] = kind.encode().ljust(4, b"\0")
    return bytes(head) + body


def generic(sprites, kind=1, layers=("main",)):
    """sprites: an int (a reference) or (width, height, frames, textures)."""
    head = b"ANIM" + struct.pack("<BBHHH", 1, kind, 0, len(layers), len(sprites)) + b"".join(n.encode() + b"\0" for n in layers)
    fixed, blobs = b"", b""
    size = sum(3 if isinstance(s, int) else 7 + 16 * len(s[2]) + 2 + 12 * len(s[3]) for s in sprites)
    for s in sprites:
        if isinstance(s, int):
            fixed += struct.pack("<BH", 1, s)
            continue
        w, h, frames, textures = s
        fixed += struct.pack("<B3H", 0, w, h, len(frames)) + b"".join(struct.pack("<HHhhHHI", *f, 0) for f in frames) + struct.pack("<H", len(textures))
        for tw, th, data in textures:
            fixed += struct.pack("<IIHH", len(head) + size + len(blobs), len(data), tw, th)
            blobs += data
    assert len(fixed) == size
    return head + fixed + blobs


def chunks(*parts):
    return b"".join(tag + struct.pack("<I", len(data)) + data for tag, data in parts)
