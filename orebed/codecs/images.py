"""Operations on RGBA arrays: team colour, sheets, resampling, comparison."""

from __future__ import annotations

import numpy as np

SHEET_COLUMNS = 17
HASH_WIDTH, HASH_HEIGHT = 9, 8
RED, WHITE = (255, 0, 0, 255), (255, 255, 255, 255)


def luminance(image: np.ndarray) -> np.ndarray:
    rgb = image[..., :3].astype(np.uint32)
    return ((299 * rgb[..., 0] + 587 * rgb[..., 1] + 114 * rgb[..., 2] + 500) // 1000).astype(np.uint8)


def mask(image: np.ndarray) -> np.ndarray:
    """A team-colour mask: grey of the luminance, clear where alpha is 0."""
    out = np.repeat(luminance(image)[..., None], 4, axis=-1)
    out[..., 3] = image[..., 3]
    out[image[..., 3] == 0] = 0
    return out


def stripped(diffuse: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """diffuse with its colours turned grey where the mask isn't clear; alpha stays."""
    if diffuse.shape != mask.shape:
        raise ValueError(f"{diffuse.shape} and {mask.shape} differ")
    out = diffuse.copy()
    where = mask[..., 3] != 0
    out[where, :3] = luminance(diffuse)[where, None]
    return out


def coloured(diffuse: np.ndarray, mask: np.ndarray, player: tuple[int, int, int]) -> np.ndarray:
    """diffuse times a player's colour, where both mask and diffuse aren't clear."""
    out = diffuse.copy()
    where = (mask[..., 3] > 0) & (diffuse[..., 3] > 0)
    out[where, :3] = diffuse[where, :3].astype(np.uint32) * np.array(player, np.uint32) // 255
    return out


def put(target: np.ndarray, part: np.ndarray, x: int, y: int) -> None:
    """Copy part into target, cut to what fits."""
    height, width = min(part.shape[0], target.shape[0] - y), min(part.shape[1], target.shape[1] - x)
    if height > 0 and width > 0:
        target[y : y + height, x : x + width] = part[:height, :width]


def sheet(frames: list[np.ndarray | None], width: int, height: int, columns: int = SHEET_COLUMNS) -> np.ndarray:
    """Frames in a grid, row by row; None leaves its cell blank."""
    out = np.zeros((max(1, -(-len(frames) // columns)) * height, columns * width, 4), np.uint8)
    for i, frame in enumerate(frames):
        if frame is not None:
            put(out, frame[:height, :width], i % columns * width, i // columns * height)
    return out


def nearest(image: np.ndarray, width: int, height: int) -> np.ndarray:
    y = ((np.arange(height) + 0.5) * image.shape[0] / height).astype(int)
    x = ((np.arange(width) + 0.5) * image.shape[1] / width).astype(int)
    return image[np.minimum(y, image.shape[0] - 1)[:, None], np.minimum(x, image.shape[1] - 1)[None, :]]


def _weights(size: int, to: int) -> np.ndarray:
    """The Lanczos-3 weights of each new place (rows) over the old ones."""
    scale = size / to
    reach = max(scale, 1.0)
    at = (np.arange(to) + 0.5) * scale - 0.5
    x = (np.arange(size)[None, :] - at[:, None]) / reach
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def lanczos(image: np.ndarray, width: int, height: int) -> np.ndarray:
    out = np.tensordot(_weights(image.shape[0], height), image.astype(np.float64), axes=(1, 0))
    out = np.moveaxis(np.tensordot(_weights(image.shape[1], width), out, axes=(1, 1)), 0, 1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def dhash(image: np.ndarray) -> int:
    """64 bits: at y * 8 + x whether a pixel of the 9 x 8 picture is darker than the one to its right. As a signed 64-bit number."""
    grey = luminance(lanczos(image, HASH_WIDTH, HASH_HEIGHT)).astype(int)
    bits = (grey[:, :-1] < grey[:, 1:]).reshape(-1)
    value = sum(1 << i for i, bit in enumerate(bits.tolist()) if bit)
    return value - (1 << 64) if value >> 63 else value


def differing(a: np.ndarray, b: np.ndarray) -> int | None:
    """How many pixels differ; None if the sizes do."""
    return int((a != b).any(axis=-1).sum()) if a.shape == b.shape else None


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Grey where the pixels are equal, red where they aren't."""
    if a.shape != b.shape:
        raise ValueError(f"{a.shape} and {b.shape} differ")
    grey = (a[..., :3].astype(np.uint32).sum(axis=-1) // 3).astype(np.uint8)
    out = np.dstack([grey, grey, grey, np.full_like(grey, 255)])
    out[(a != b).any(axis=-1)] = RED
    return out


def side_by_side(a: np.ndarray, b: np.ndarray, gap: int = 10) -> np.ndarray:
    """Two pictures with a white gap; the lower one is filled up with white."""
    out = np.empty((max(a.shape[0], b.shape[0]), a.shape[1] + gap + b.shape[1], 4), np.uint8)
    out[:] = WHITE
    put(out, a, 0, 0)
    put(out, b, a.shape[1] + gap, 0)
    return out


def tinted(image: np.ndarray, tint: tuple[int, int, int]) -> np.ndarray:
    """A tint times the mean of each pixel's channels; alpha stays."""
    mean = image[..., :3].astype(np.uint32).sum(axis=-1) // 3
    out = image.copy()
    out[..., :3] = np.array(tint, np.uint32)[None, None, :] * mean[..., None] // 255
    return out
