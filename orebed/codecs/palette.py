"""Palettes of up to 256 RGBA colours, as arrays of shape (n, 4)."""

from __future__ import annotations

import numpy as np

#: What a missing index shows.
MAGENTA = (255, 0, 255, 255)


def validated(palette: np.ndarray) -> np.ndarray:
    if not 0 < len(palette) <= 256:
        raise ValueError(f"a palette has 1 to 256 colours, not {len(palette)}")
    return np.asarray(palette, np.uint8).reshape(-1, 4)


def from_triplets(data: bytes) -> np.ndarray:
    """RGB triplets; a channel of at most 63 is taken as 6 bits and scaled up. Index 0 is clear."""
    if not data or len(data) % 3 or len(data) > 768:
        raise ValueError(f"{len(data)} bytes are no palette of RGB triplets")
    rgb = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.uint32)
    rgb = np.where(rgb <= 63, rgb * 255 // 63, rgb)
    out = np.full((len(rgb), 4), 255, np.uint8)
    out[:, :3] = rgb
    out[0, 3] = 0
    return out


def from_bgr0(data: bytes) -> np.ndarray:
    """256 entries of blue, green, red and a spare byte."""
    raw = np.frombuffer(data[:1024], np.uint8).reshape(-1, 4)
    out = np.full((len(raw), 4), 255, np.uint8)
    out[:, :3] = raw[:, [2, 1, 0]]
    return out


def grey(clear_first: bool = True) -> np.ndarray:
    out = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    out[:, 3] = 255
    if clear_first:
        out[0, 3] = 0
    return out


# After 16 greys, ramps of 16 colours, each as its first colour and the step to the next.
DEFAULT_RAMPS = (((255, 0, 0), (0, 16, 16)), ((0, 255, 0), (16, 0, 16)), ((0, 0, 255), (16, 16, 0)))
SPRITE_RAMPS = (
    ((255, 128, 128), (0, 8, 8)),
    ((128, 128, 255), (8, 8, 0)),
    ((128, 255, 128), (8, 0, 8)),
    ((255, 255, 200), (0, 0, 3)),
    ((255, 128, 255), (0, 8, 0)),
    ((255, 128, 128), (0, 8, 0)),
    ((139, 69, 19), (4, 6, 2)),
)
# The step between greys, and the factors of an index beyond the ramps.
GREY_STEP, SPREAD = 17, (7, 11, 13)


def _synthetic(ramps: tuple) -> np.ndarray:
    out = np.full((256, 4), 255, np.uint8)
    out[:, :3] = np.arange(256)[:, None] * np.array(SPREAD) % 256
    shades = np.arange(16)[:, None]
    for block, (first, step) in enumerate((((0, 0, 0), (GREY_STEP,) * 3), *ramps)):
        out[16 * block : 16 * block + 16, :3] = np.array(first) + shades * np.array(step)
    out[0, 3] = 0
    return out


def default() -> np.ndarray:
    """The synthetic palette of units; index 0 is clear."""
    return _synthetic(DEFAULT_RAMPS)


def for_sprites() -> np.ndarray:
    """The synthetic palette with players' colours, for run-length sprites; index 0 is clear."""
    return _synthetic(SPRITE_RAMPS)


def looked_up(indices: np.ndarray, palette: np.ndarray, clear: int | None = None) -> np.ndarray:
    """RGBA of indices; magenta beyond the palette; the index `clear` is fully transparent."""
    table = np.tile(np.array(MAGENTA, np.uint8), (256, 1))
    table[: len(palette)] = validated(palette)
    if clear is not None:
        table[clear, 3] = 0
    # one word a pixel is gathered, not four bytes
    return table.view(np.uint32).reshape(256)[indices].view(np.uint8).reshape(*indices.shape, 4)
