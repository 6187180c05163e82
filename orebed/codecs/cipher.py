"""Encrypted blocks: their frame, and the Salsa20 stream cipher. Keys are given by the caller."""

from __future__ import annotations

import numpy as np

# The cipher's constants.
SIGMA, TAU = b"expand 32-byte k", b"expand 16-byte k"
ROUNDS = 20


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint32(n) | x >> np.uint32(32 - n)


def _quarter(x: np.ndarray, a: int, b: int, c: int, d: int) -> None:
    for to, p, q, n in ((b, a, d, 7), (c, b, a, 9), (d, c, b, 13), (a, d, c, 18)):
        x[to] ^= _turn(x[p] + x[q], n)


def salsa20(data: bytes, key: bytes, nonce: bytes) -> bytes:
    """Encrypts and decrypts; all blocks at once."""
    if len(key) not in (16, 32) or len(nonce) != 8:
        raise ValueError("a key has 16 or 32 bytes, a nonce 8")
    blocks = -(-len(data) // 64)
    word = lambda b: np.frombuffer(b, "<u4")
    constant, low, high = word(SIGMA if len(key) == 32 else TAU), word(key[:16]), word(key[-16:])
    state = np.zeros((16, blocks), np.uint32)
    state[[0, 5, 10, 15]] = constant[:, None]
    state[1:5], state[11:15] = low[:, None], high[:, None]
    state[6:8] = word(nonce)[:, None]
    count = np.arange(blocks, dtype=np.uint64)
    state[8], state[9] = (count & np.uint64(0xFFFFFFFF)).astype(np.uint32), (count >> np.uint64(32)).astype(np.uint32)
    x = state.copy()
    for _ in range(ROUNDS // 2):
        for i in range(4):
            _quarter(x, *((5 * i + 4 * j) % 16 for j in range(4)))
        for i in range(4):
            _quarter(x, *(4 * i + (i + j) % 4 for j in range(4)))
    stream = np.ascontiguousarray((x + state).T).astype("<u4").tobytes()
    return (np.frombuffer(data, np.uint8) ^ np.frombuffer(stream[: len(data)], np.uint8)).tobytes()


def decrypt_block(data: bytes, frame: int, keys: dict[int, bytes]) -> bytes:
    """A framed block: key name (0 or 8 bytes), nonce (4 or 8), kind S or A, data. Kind A isn't supported."""
    at = 0

    def take(n: int, what: str) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError(f"cut short: {what}")
        at += n
        return data[at - n : at]

    size = take(1, "size of the key's name")[0]
    if size not in (0, 8):
        raise ValueError(f"a key's name of {size} bytes")
    name = int.from_bytes(take(size, "the key's name"), "little")
    size = take(1, "size of the nonce")[0]
    if size not in (4, 8):
        raise ValueError(f"a nonce of {size} bytes")
    nonce = bytearray(take(size, "the nonce").ljust(8, b"\0"))
    kind = take(1, "the kind")
    if kind not in (b"S", b"A"):
        raise ValueError(f"encryption of kind {kind!r}")
    if name not in keys:
        raise ValueError(f"no key {name:016X}")
    for i in range(4):
        nonce[i] ^= frame >> 8 * i & 255
    if kind == b"A":
        raise ValueError("this kind of encryption isn't supported")
    return salsa20(data[at:], keys[name], bytes(nonce))
