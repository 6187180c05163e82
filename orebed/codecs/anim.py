"""Layered sprite containers: the generic kind, the high-definition kind and the standard-definition kind."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from orebed.codecs import textures

# Magic, versions and layout.
MAGIC = b"ANIM"
SD_VERSION = 0x0101
NAMES_AT, NAME_SIZE, NAME_COUNT, ENTRIES_AT = 12, 32, 10, 332
MAX_NAME = 1024
TEAM_COLOUR, TEAM_COLOUR_PLACE, DIFFUSE_PLACE = "teamcolor", 2, 0


class Reader:
    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def take(self, kinds: str) -> tuple[int, ...]:
        size = struct.calcsize("<" + kinds)
        if self.at + size > len(self.data):
            raise ValueError("cut short")
        out = struct.unpack_from("<" + kinds, self.data, self.at)
        self.at += size
        return out

    def name(self) -> str:
        end = self.data.find(b"\0", self.at, self.at + MAX_NAME + 1)
        if end < 0:
            raise ValueError("a name without an end")
        out = self.data[self.at : end].decode(errors="replace")
        self.at = end + 1
        return out


@dataclass
class Frame:
    x: int
    y: int
    x_offset: int
    y_offset: int
    width: int
    height: int


@dataclass
class Texture:
    width: int
    height: int
    data: bytes

    def pixels(self, palette: np.ndarray | None = None) -> np.ndarray:
        return textures.decode(self.data, self.width, self.height, palette)


@dataclass
class GenericSprite:
    width: int = 0
    height: int = 0
    frames: list[Frame] = field(default_factory=list)
    textures: list[Texture] = field(default_factory=list)
    reference: int | None = None


@dataclass
class Generic:
    scale: int
    kind: int
    layers: list[str]
    sprites: list[GenericSprite]
    failed: list[tuple[int, str]]


def parse_generic(data: bytes) -> Generic:
    """A sprite that fails is left out, and the next is read from where it stopped. References name sprites that were read."""
    r = Reader(data)
    if data[:4] != MAGIC:
        raise ValueError("no sprite container")
    r.at = 4
    scale, kind, _, layer_count, sprite_count = r.take("BBHHH")
    if kind not in (1, 2):
        raise ValueError(f"container of kind {kind}")
    layers = [r.name() for _ in range(min(layer_count, NAME_COUNT))]
    sprites, failed = [], []
    for i in range(sprite_count):
        try:
            sprites.append(_generic_sprite(r))
        except ValueError as e:
            failed.append((i, str(e)))
    for i, s in enumerate(sprites):
        if s.reference is not None and s.reference < i:
            there = sprites[s.reference]
            s.width, s.height, s.frames, s.textures = there.width, there.height, there.frames, there.textures
    return Generic(scale, kind, layers, sprites, failed)


def _generic_sprite(r: Reader) -> GenericSprite:
    if r.take("B")[0]:
        return GenericSprite(reference=r.take("H")[0])
    width, height, frames = r.take("HHH")
    out = GenericSprite(width, height)
    for _ in range(frames):
        x, y, xo, yo, w, h, _ = r.take("HHhhHHI")
        out.frames.append(Frame(x, y, xo, yo, w, h))
    for _ in range(r.take("H")[0]):
        offset, size, w, h = r.take("IIHH")
        if offset + size > len(r.data):
            raise ValueError("a texture lies beyond the end")
        out.textures.append(Texture(w, h, r.data[offset : offset + size]))
    return out


@dataclass
class Layer:
    index: int
    name: str
    width: int
    height: int
    data: bytes


@dataclass
class Layered:
    """One entry of a high-definition container; layers keep their places, empty ones too."""

    version: int
    names: list[str]
    width: int
    height: int
    layers: list[Layer]
    frames: list[Frame]

    def layer(self, index: int) -> Layer | None:
        found = self.layers[index] if 0 <= index < len(self.layers) else None
        return found if found and found.data else None

    def diffuse(self) -> Layer | None:
        return self.layer(DIFFUSE_PLACE)

    def team_colour(self) -> Layer | None:
        """The layer of that name in any case, else the one in its usual place."""
        return self.layer(next((i for i, n in enumerate(self.names) if n.lower() == TEAM_COLOUR), TEAM_COLOUR_PLACE))


def _header(data: bytes) -> tuple[int, int, int, list[str]]:
    """Version, layers, entries, names."""
    r = Reader(data)
    if data[:4] != MAGIC:
        raise ValueError("no sprite container")
    r.at = 4
    version, _, layers, entries = r.take("4H")
    if len(data) < ENTRIES_AT:
        raise ValueError("cut short")
    names = [data[NAMES_AT + i * NAME_SIZE :][:NAME_SIZE].split(b"\0")[0].decode(errors="replace") for i in range(NAME_COUNT)]
    return version, layers, entries, names


def parse_layered(data: bytes) -> Layered:
    """The first entry of a high-definition container."""
    version, count, entries, names = _header(data)
    if version == SD_VERSION:
        raise ValueError("a standard-definition container")
    if not entries:
        raise ValueError("no entry")
    r = Reader(data, ENTRIES_AT)
    frames, _, width, height, pointer = r.take("HHHHI")
    layers = []
    for i in range(NAME_COUNT):
        at, size, w, h = r.take("IIHH")
        if i < count:
            if at + size > len(data):
                raise ValueError("a layer lies beyond the end")
            layers.append(Layer(i, names[i], w, h, data[at : at + size] if at and size else b""))
    r.at = pointer
    return Layered(version, names[:count], width, height, layers, [Frame(*r.take("HHhhHHHH")[:6]) for _ in range(frames)])


@dataclass
class StandardSprite:
    width: int
    height: int
    frames: list[list[Frame]]  # for each frame its layers
    data: list[bytes]  # of each layer


def parse_standard(data: bytes) -> tuple[list[str], list[StandardSprite]]:
    """Layer names and sprites of a standard-definition container; any fault is one of the whole file."""
    version, count, sprites, names = _header(data)
    if version != SD_VERSION:
        raise ValueError(f"version {version:#06x}")
    table = Reader(data, ENTRIES_AT)
    out = []
    for (at,) in [table.take("I") for _ in range(sprites)]:
        r = Reader(data, at)
        frames, _, _, pointer, first, first_size, width, height, second, second_size, _, _ = r.take("HHIIIIHHIIHH")
        parts = [(first, first_size)] + ([(second, second_size)] if second else [])
        if any(a + n > len(data) for a, n in parts):
            raise ValueError("a texture lies beyond the end")
        r.at = pointer
        placed = [[Frame(*r.take("HHhhHHHH")[:6]) for _ in parts] for _ in range(frames if pointer else 0)]
        out.append(StandardSprite(width, height, placed, [data[a : a + n] if a else b"" for a, n in parts]))
    return names[:count], out


def crop(image: np.ndarray, f: Frame) -> np.ndarray:
    """A frame's pixels from its atlas, clear where it leaves it."""
    out = np.zeros((f.height, f.width, 4), np.uint8)
    part = image[f.y : f.y + f.height, f.x : f.x + f.width]
    out[: part.shape[0], : part.shape[1]] = part
    return out
