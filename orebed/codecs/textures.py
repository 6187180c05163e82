"""Texture payloads to RGBA arrays: block compression, indices, zlib, LZ4 blocks, DDS files."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from orebed.codecs import palette as palettes

# Magic numbers.
ZLIB_HEADS = (b"\x78\x01", b"\x78\x9c", b"\x78\xda")
LZ4_FRAME = bytes.fromhex("04224D18")
DDS = b"DDS "
DDS_HEADER = 128
BLOCK_BYTES = {"DXT1": 8, "DXT5": 16}


def rgb565(c: np.ndarray) -> np.ndarray:
    """Channels in the last axis, low bits filled with the high ones."""
    c = c.astype(np.uint32)
    r, g, b = c >> 11 & 31, c >> 5 & 63, c & 31
    return np.stack([r << 3 | r >> 2, g << 2 | g >> 4, b << 3 | b >> 2], axis=-1)


def _colours(blocks: np.ndarray, opaque: bool) -> np.ndarray:
    """The pixels (n, 16, 4) of colour blocks of 8 bytes; opaque: always four colours."""
    ends = blocks[:, :4].copy().view("<u2").astype(np.uint32)
    a, b = rgb565(ends[:, 0]), rgb565(ends[:, 1])
    four = (np.full(len(blocks), True) if opaque else ends[:, 0] > ends[:, 1])[:, None]
    table = np.zeros((len(blocks), 4, 4), np.uint32)
    table[:, :, 3] = 255
    table[:, 0, :3], table[:, 1, :3] = a, b
    table[:, 2, :3] = np.where(four, (2 * a + b) // 3, (a + b) // 2)
    table[:, 3, :3] = np.where(four, (a + 2 * b) // 3, 0)
    table[:, 3, 3] = np.where(four[:, 0], 255, 0)
    bits = blocks[:, 4:8].copy().view("<u4")
    index = bits >> (2 * np.arange(16, dtype=np.uint32))[None, :] & 3
    words = table.astype(np.uint8).view(np.uint32)[:, :, 0]  # a colour is one word
    return np.take_along_axis(words, index.astype(np.int64), axis=1).view(np.uint8).reshape(-1, 16, 4)


def _alphas(blocks: np.ndarray) -> np.ndarray:
    """The alpha (n, 16) of blocks of 8 bytes."""
    a, b = blocks[:, 0].astype(np.uint32), blocks[:, 1].astype(np.uint32)
    table = np.zeros((len(blocks), 8), np.uint32)
    table[:, 0], table[:, 1] = a, b
    for i in range(1, 7):
        seven = ((7 - i) * a + i * b) // 7
        five = ((5 - i) * a + i * b) // 5 if i < 5 else np.full_like(a, 0 if i == 5 else 255)
        table[:, i + 1] = np.where(a > b, seven, five)
    wide = np.zeros((len(blocks), 8), np.uint8)
    wide[:, :6] = blocks[:, 2:8]
    index = wide.view("<u8") >> (3 * np.arange(16, dtype=np.uint64))[None, :] & np.uint64(7)
    return np.take_along_axis(table, index.astype(np.int64), axis=1)


def _tiled(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Blocks of 4 x 4 pixels, row by row, as an image cut to its size."""
    across, down = -(-width // 4), -(-height // 4)
    image = pixels.reshape(down, across, 4, 4, 4).swapaxes(1, 2).reshape(down * 4, across * 4, 4)
    return np.ascontiguousarray(image[:height, :width])


def decode_blocks(kind: str, data: bytes, width: int, height: int, strict: bool = True) -> np.ndarray:
    """DXT1 or DXT5. strict: the size must be exact; else missing blocks are clear and surplus ones ignored."""
    size = BLOCK_BYTES[kind] * (-(-width // 4)) * (-(-height // 4))
    if strict and len(data) != size:
        raise ValueError(f"{kind} of {width} x {height} has {size} bytes, not {len(data)}")
    whole = data[:size][: len(data[:size]) // BLOCK_BYTES[kind] * BLOCK_BYTES[kind]]
    blocks = np.frombuffer(whole, np.uint8).reshape(-1, BLOCK_BYTES[kind])
    pixels = np.zeros((size // BLOCK_BYTES[kind], 16, 4), np.uint8)
    if kind == "DXT1":
        pixels[: len(blocks)] = _colours(blocks, False)
    else:
        pixels[: len(blocks)] = _colours(blocks[:, 8:], True)
        pixels[: len(blocks), :, 3] = _alphas(blocks[:, :8])
    return _tiled(pixels, width, height)


def lz4_block(data: bytes, size: int) -> bytes:
    """An LZ4 block of a known decoded size."""
    out, i = bytearray(), 0

    def more(n: int) -> int:
        nonlocal i
        if n == 15:
            while True:
                n += data[i]
                i += 1
                if data[i - 1] != 255:
                    break
        return n

    try:
        while i < len(data):
            token = data[i]
            i += 1
            literals = more(token >> 4)
            if i + literals > len(data):
                raise ValueError("literals are cut short")
            out += data[i : i + literals]
            i += literals
            if i >= len(data):
                break
            back = data[i] | data[i + 1] << 8
            i += 2
            length = more(token & 15) + 4
            if not 0 < back <= len(out):
                raise ValueError("a match lies before the start")
            while length > 0:  # a match may overlap what it makes
                part = out[-back:][:length] if back <= length else out[len(out) - back : len(out) - back + length]
                out += part
                length -= len(part)
            if len(out) > size:
                raise ValueError("more bytes than announced")
    except IndexError:
        raise ValueError("the block is cut short") from None
    if len(out) != size:
        raise ValueError(f"{len(out)} bytes, not {size}")
    return bytes(out)


def sized_lz4(data: bytes, expected: int | None = None) -> bytes:
    """A block after its decoded size as a u32; the size must be the expected one if that is known."""
    if len(data) < 4:
        raise ValueError("no size")
    size = int.from_bytes(data[:4], "little")
    out = lz4_block(data[4:], size)
    if expected is not None and len(out) != expected:
        raise ValueError(f"{len(out)} bytes, not {expected}")
    return out


def compressed_like(data: bytes) -> bool:
    return len(data) >= 64 and len(set(data[:1024])) > 0.8 * 256


def dds_kind(data: bytes) -> str | None:
    """The four-character code of a DDS header, `RGBA` without one, or None if this is no DDS."""
    if len(data) < DDS_HEADER or data[:4] != DDS:
        return None
    code = data[84:88]
    return code.decode("latin-1") if code.strip(b"\0") else "RGBA"


def sniff(data: bytes, width: int, height: int) -> tuple[str, str]:
    """(compression, pixel format) of a texture's bytes, by the first rule that fits."""
    area = width * height
    if len(data) < 4:
        return "none", "mono"
    if data[:4] == DDS:
        return "none", f"dds:{dds_kind(data) or 'unknown'}"
    if data[:2] in ZLIB_HEADS:
        return "zlib", "unknown"
    if data[:4] == LZ4_FRAME:
        return "lz4", "unknown"
    prefix = int.from_bytes(data[:4], "little")
    for channels, name in ((4, "rgba"), (3, "rgb"), (1, "mono")):
        if area and prefix == area * channels:
            return "lz4", name
    if compressed_like(data):
        return "zlib", "unknown"
    return "none", "rgba" if len(data) % 4 == 0 else "mono"


def _of_length(data: bytes, area: int) -> str:
    return {area * 4: "rgba", area * 3: "rgb", area: "mono"}.get(len(data), "rgba")


def indexed4(data: bytes, area: int) -> np.ndarray:
    """Two indices a byte, the high half first."""
    raw = np.frombuffer(data, np.uint8)
    return np.stack([raw >> 4, raw & 15], axis=1).reshape(-1)[:area]


def to_rgba(data: bytes, pixel_format: str, width: int, height: int, palette: np.ndarray | None = None) -> np.ndarray:
    """Raw pixels: rgba, rgb, mono, indexed8 or indexed4."""
    area = width * height
    need = {"rgba": 4 * area, "rgb": 3 * area, "mono": area, "indexed8": area, "indexed4": -(-area // 2)}[pixel_format]
    if len(data) != need:
        raise ValueError(f"{pixel_format} of {width} x {height} has {need} bytes, not {len(data)}")
    raw = np.frombuffer(data, np.uint8)
    if pixel_format == "rgba":
        out = raw.reshape(-1, 4)
    elif pixel_format == "rgb":
        out = np.column_stack([raw.reshape(-1, 3), np.full(area, 255, np.uint8)])
    elif pixel_format == "indexed4":
        out = palettes.looked_up(indexed4(data, area), palettes.grey(False) if palette is None else palette)
    else:
        grey = pixel_format == "mono" or palette is None
        out = palettes.looked_up(raw, palettes.grey(False) if grey else palette)
    return out.reshape(height, width, 4).copy()


def decode_dds(data: bytes) -> np.ndarray:
    """A DDS file with DXT1, DXT5 or plain 32-bit pixels; missing blocks are clear."""
    kind = dds_kind(data)
    if kind is None:
        raise ValueError("no DDS header")
    height, width = struct.unpack_from("<2I", data, 12)
    body = data[DDS_HEADER:]
    if not (0 < width <= 1 << 15 and 0 < height <= 1 << 15):
        raise ValueError(f"{width} x {height} pixels")
    if kind in BLOCK_BYTES:
        return decode_blocks(kind, body, width, height, strict=False)
    if kind != "RGBA" or len(body) < width * height * 4:
        raise ValueError(f"DDS of kind {kind} and {len(body)} bytes")
    raw = np.frombuffer(body[: width * height * 4], np.uint8).reshape(height, width, 4)
    blue_first = struct.unpack_from("<I", data, 92)[0] == 0x00FF0000
    return raw[:, :, [2, 1, 0, 3]].copy() if blue_first else raw.copy()


def decode(data: bytes, width: int, height: int, palette: np.ndarray | None = None) -> np.ndarray:
    """RGBA of a texture whose format is sniffed."""
    compression, pixels = sniff(data, width, height)
    if pixels.startswith("dds:"):
        return decode_dds(data)
    if compression == "zlib":
        try:
            data = zlib.decompress(data)
        except zlib.error as e:
            raise ValueError(f"zlib: {e}") from e
        pixels = _of_length(data, width * height)
    elif compression == "lz4":
        data = sized_lz4(data)
        pixels = _of_length(data, width * height)
    if pixels == "mono" and palette is not None:
        pixels = "indexed8"
    return to_rgba(data, pixels, width, height, palette)
