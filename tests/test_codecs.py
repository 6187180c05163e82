import struct
import zlib

import builders
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orebed.codecs import anim, cipher, grp, images, palette, png, textures

# run-length sprites


def test_literal_sprite():
    data = bytes.fromhex("010003000200" + "00000000" + "0E000000" + "04000800" + "426441C8" + "43C8")
    assert grp.parse(data).frame().tolist() == [[100, 100, 200], [200, 200, 200]]


def test_runs_are_cut_and_literals_may_be_empty():
    assert grp.line(bytes([0x45, 9]), 2).tolist() == [9, 9]
    assert grp.line(bytes([0, 0x81, 2, 7, 8, 1, 9]), 3).tolist() == [0, 7, 8]


@settings(max_examples=100, deadline=None)
@given(st.data())
def test_sprites_round_trip(data):
    w, h, n = data.draw(st.integers(1, 90)), data.draw(st.integers(1, 12)), data.draw(st.integers(1, 4))
    frames = [np.array(data.draw(st.lists(st.sampled_from([0, 0, 1, 7, 255]), min_size=w * h, max_size=w * h)), np.uint8).reshape(h, w) for _ in range(n)]
    sprite = grp.parse(builders.grp(frames, w, h))
    assert all((a == b).all() for a, b in zip(sprite.frames, frames)) and len(sprite.frames) == n
    one = grp.rgba(sprite.frames[0], None, transparent_zero=True)
    assert (one[sprite.frames[0] == 0, 3] == 0).all() and (one[sprite.frames[0] != 0, 3] == 255).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=6), st.integers(1, 20))
def test_lines_together_as_one_by_one(runs, width):
    ends = np.cumsum([len(r) for r in runs])
    got = grp.lines(np.frombuffer(b"".join(runs), np.uint8), ends - [len(r) for r in runs], ends, width)
    assert got.tolist() == [grp.line(r, width).tolist() for r in runs]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300))
def test_parsers_raise_nothing_but_value_errors(data):
    for parse in (grp.parse, anim.parse_generic, anim.parse_layered, anim.parse_standard, png.decode, textures.decode_dds, lambda d: textures.decode(d, 8, 8), lambda d: textures.sized_lz4(d)):
        for bytes_ in (data, b"ANIM" + data):
            try:
                parse(bytes_)
            except (ValueError, struct.error, zlib.error):
                pass


def test_54_small_frames():
    assert len(grp.parse(builders.grp([np.full((1, 1), i) for i in range(54)], 1, 1)).frames) == 54


def test_limits():
    for head in ((0, 1, 1), (1001, 1, 1), (1, 0, 1), (1, 2049, 1)):
        with pytest.raises(ValueError):
            grp.parse(struct.pack("<3H", *head) + bytes(9000))
    assert grp.frame_end([10, 50, 30, 40], 0, 99) == 50 and grp.frame_end([10, 50, 30, 40], 1, 99) == 99


# palettes


def test_synthetic_palettes():
    plain, players = palette.default(), palette.for_sprites()
    for p in (plain, players):
        assert p.shape == (256, 4) and p[0].tolist() == [0] * 4 and p[15].tolist() == [255] * 4 and p[1:, 3].min() == 255
        assert p[200].tolist() == [200 * 7 % 256, 200 * 11 % 256, 200 * 13 % 256, 255]
    assert plain[[16, 31, 33, 50, 64], :3].tolist() == [[255, 0, 0], [255, 240, 240], [16, 255, 16], [32, 32, 255], [192, 192, 64]]
    assert players[[16, 32, 63, 65, 81, 97, 127], :3].tolist() == [
        [255, 128, 128], [128, 128, 255], [248, 255, 248], [255, 255, 203], [255, 136, 255], [255, 136, 128], [199, 159, 49],
    ]


def test_palettes():
    p = palette.from_triplets(bytes([1, 2, 3, 63, 64, 255]))
    assert p.tolist() == [[4, 8, 12, 0], [255, 64, 255, 255]]
    assert palette.looked_up(np.array([1, 9]), p).tolist() == [[255, 64, 255, 255], [255, 0, 255, 255]]
    for bad in (b"", b"12", bytes(771)):
        with pytest.raises(ValueError):
            palette.from_triplets(bad)


# block compression, pixel by pixel


def plain_dxt(kind, data, width, height):
    out = np.zeros((height, width, 4), np.uint8)
    step = textures.BLOCK_BYTES[kind]
    for n in range(len(data) // step):
        block = data[n * step : (n + 1) * step]
        alpha = None
        if kind == "DXT5":
            a, b = block[0], block[1]
            ramp = [a, b] + [((7 - i) * a + i * b) // 7 for i in range(1, 7)] if a > b else [a, b] + [((5 - i) * a + i * b) // 5 for i in range(1, 5)] + [0, 255]
            bits = int.from_bytes(block[2:8], "little")
            alpha = [ramp[bits >> 3 * i & 7] for i in range(16)]
            block = block[8:]
        c0, c1, index = struct.unpack("<HHI", block)
        one, two = ([(c >> 11) << 3 | c >> 13, (c >> 5 & 63) << 2 | (c >> 5 & 63) >> 4, (c & 31) << 3 | (c & 31) >> 2] for c in (c0, c1))
        if kind == "DXT5" or c0 > c1:
            table = [one + [255], two + [255], [(2 * x + y) // 3 for x, y in zip(one, two)] + [255], [(x + 2 * y) // 3 for x, y in zip(one, two)] + [255]]
        else:
            table = [one + [255], two + [255], [(x + y) // 2 for x, y in zip(one, two)] + [255], [0, 0, 0, 0]]
        for i in range(16):
            y, x = n // -(-width // 4) * 4 + i // 4, n % -(-width // 4) * 4 + i % 4
            if y < height and x < width:
                out[y, x] = table[index >> 2 * i & 3]
                if alpha:
                    out[y, x, 3] = alpha[i]
    return out


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(["DXT1", "DXT5"]), st.integers(1, 13), st.integers(1, 9), st.integers(0, 10**6))
def test_blocks_as_pixel_by_pixel(kind, w, h, seed):
    size = textures.BLOCK_BYTES[kind] * -(-w // 4) * -(-h // 4)
    data = np.random.default_rng(seed).integers(0, 256, size, dtype=np.uint8).tobytes()
    assert (textures.decode_blocks(kind, data, w, h) == plain_dxt(kind, data, w, h)).all()
    assert (textures.decode_dds(builders.dds(kind, w, h, data)) == plain_dxt(kind, data, w, h)).all()


def test_short_blocks():
    with pytest.raises(ValueError):
        textures.decode_blocks("DXT1", bytes(7), 4, 4)
    assert textures.decode_blocks("DXT1", bytes(7), 4, 4, strict=False).sum() == 0


# packed textures


def lz4(data):
    """Literals, then overlapping matches of a repeated byte."""
    n = len(data)
    out = bytes([min(n, 15) << 4])
    if n >= 15:
        out += b"\xff" * ((n - 15) // 255) + bytes([(n - 15) % 255])
    return out + data


def test_lz4():
    assert textures.sized_lz4((5).to_bytes(4, "little") + lz4(b"hello")) == b"hello"
    run = bytes([0x1F]) + b"a" + b"\x01\x00" + bytes([80]) + bytes([0x10]) + b"b"
    assert textures.lz4_block(run, 101) == b"a" * 100 + b"b"
    for bad, size in ((run, 100), (bytes([0x10]) + b"a\x05\x00", 5), (b"\xf0", 3)):
        with pytest.raises(ValueError):
            textures.lz4_block(bad, size)


def test_sniffing_and_decoding():
    rgba = bytes([128]) * (8 * 8 * 4)
    assert textures.decode(zlib.compress(rgba), 8, 8).tobytes() == rgba
    assert textures.decode(len(rgba).to_bytes(4, "little") + lz4(rgba), 8, 8).tobytes() == rgba
    assert textures.decode(rgba, 8, 8).tobytes() == rgba
    assert textures.sniff(b"ab", 1, 2) == ("none", "mono") and textures.sniff(b"DDS " + bytes(4), 1, 1)[1] == "dds:unknown"
    assert textures.sniff(bytes(range(256)), 3, 3) == ("zlib", "unknown") and textures.sniff(b"\x04\x22\x4d\x18", 9, 9)[0] == "lz4"
    with pytest.raises(ValueError):
        textures.decode(b"\x78\x9cxx", 2, 2)
    assert textures.to_rgba(b"\x12\x30", "indexed4", 3, 1)[0, :, 0].tolist() == [1, 2, 3]
    assert textures.to_rgba(b"\x05", "mono", 1, 1).tolist() == [[[5, 5, 5, 255]]]
    assert textures.to_rgba(b"\x01\x02\x03", "rgb", 1, 1).tolist() == [[[1, 2, 3, 255]]]


# containers


def test_layered_container():
    data = builders.layered([("diffuse", 8, 4, b"DDS one"), ("bright", 0, 0, b""), ("TeamColor", 8, 4, b"DDS two")], [(1, 2, -3, 4, 5, 6)])
    a = anim.parse_layered(data)
    assert a.diffuse().data == b"DDS one" and a.team_colour().data == b"DDS two" and a.layer(1) is None
    assert a.frames == [anim.Frame(1, 2, -3, 4, 5, 6)] and (a.width, a.height) == (64, 32)
    with pytest.raises(ValueError):
        anim.parse_layered(builders.layered([], [], version=0x0101))


def test_standard_container():
    f = (1, 2, -1, -2, 3, 4)
    names, sprites = anim.parse_standard(builders.standard([([[f], [f]], [b"aa"]), ([[f, f]], [b"bbb", b"cc"])]))
    assert names == ["diffuse", "teamcolor"] and [len(s.frames) for s in sprites] == [2, 1]
    assert sprites[1].data == [b"bbb", b"cc"] and sprites[1].frames[0][1].x_offset == -1 and sprites[0].width == 8
    with pytest.raises(ValueError):
        anim.parse_standard(builders.standard([([[f]], [b"aa"])])[:-1])


def test_generic_container_resolves_earlier_references():
    pixel = bytes([128]) * 64
    a = anim.parse_generic(builders.generic([(4, 4, [(0, 0, 0, 0, 4, 4)], [(4, 4, pixel)]), 0, 1, 9]))
    assert [len(s.textures) for s in a.sprites] == [1, 1, 1, 0] and a.sprites[2].frames and a.sprites[2].reference == 1
    assert a.sprites[0].textures[0].pixels().tobytes() == pixel
    for bad in (b"NOPE", builders.generic([], kind=3), b""):
        with pytest.raises(ValueError):
            anim.parse_generic(bad)


# pictures


def test_png_round_trip():
    image = np.random.default_rng(1).integers(0, 256, (7, 5, 4), dtype=np.uint8)
    for level in (0, 5, 9):
        data = png.encode(image, level)
        assert (png.decode(data) == image).all() and png.size(data) == (5, 7)


def test_png_filters():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (5, 4, 4), dtype=np.uint8)
    raw, above = b"", np.zeros(16, int)
    for kind, row in enumerate(image.reshape(5, 16).astype(int)):
        left, corner = np.r_[np.zeros(4, int), row[:-4]], np.r_[np.zeros(4, int), above[:-4]]
        p = left + above - corner
        d = np.stack([abs(p - left), abs(p - above), abs(p - corner)])
        guess = [0 * row, left, above, (left + above) // 2, np.choose(d.argmin(axis=0), [left, above, corner])][kind]
        raw += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    data = png.SIGNATURE + png._chunk(b"IHDR", struct.pack(">2I5B", 4, 5, 8, 6, 0, 0, 0)) + png._chunk(b"IDAT", zlib.compress(raw)) + png._chunk(b"IEND", b"")
    assert (png.decode(data) == image).all()


def test_differences():
    grey = np.full((64, 64, 4), (128, 128, 128, 255), np.uint8)
    red = grey.copy()
    red[:] = (255, 0, 0, 255)
    two = grey.copy()
    two[10, 10] = two[20, 20] = (255, 0, 0, 255)
    assert images.differing(grey, red) == 4096 and images.differing(grey, two) == 2 and images.differing(grey, grey[1:]) is None
    diff = images.difference(grey, two)
    assert diff[10, 10].tolist() == [255, 0, 0, 255] and diff[0, 0].tolist() == [128, 128, 128, 255]
    side = images.side_by_side(grey, grey[:32], 20)
    assert side.shape == (64, 148, 4) and side[0, 70].tolist() == [255] * 4 and side[40, 100].tolist() == [255] * 4


def test_hash_follows_brightness():
    ramp = np.repeat(np.linspace(0, 255, 90).astype(np.uint8)[None, :, None], 80, axis=0)
    image = np.concatenate([ramp, ramp, ramp, np.full_like(ramp, 255)], axis=2)
    assert images.dhash(image) == -1 and images.dhash(image[:, ::-1]) == 0


def test_team_colour():
    diffuse = np.array([[[200, 100, 50, 255], [10, 20, 30, 255], [9, 9, 9, 0]]], np.uint8)
    m = images.mask(np.array([[[255, 255, 255, 255], [1, 2, 3, 0], [4, 4, 4, 255]]], np.uint8))
    assert m.tolist() == [[[255, 255, 255, 255], [0, 0, 0, 0], [4, 4, 4, 255]]]
    lum = (299 * 200 + 587 * 100 + 114 * 50 + 500) // 1000
    assert images.stripped(diffuse, m)[0, 0].tolist() == [lum, lum, lum, 255] and images.stripped(diffuse, m)[0, 1].tolist() == [10, 20, 30, 255]
    assert images.coloured(diffuse, m, (0, 255, 127))[0].tolist() == [[0, 100, 24, 255], [10, 20, 30, 255], [9, 9, 9, 0]]
    with pytest.raises(ValueError):
        images.stripped(diffuse, m[:, :1])


def test_resampling():
    image = np.full((6, 8, 4), 77, np.uint8)
    assert (images.lanczos(image, 3, 9) == 77).all()
    assert images.nearest(np.arange(16, dtype=np.uint8).reshape(4, 4, 1), 2, 2)[..., 0].tolist() == [[5, 7], [13, 15]]


# cipher


def test_salsa20_known_answer():
    # the first block of the published test vector set 1, vector 0 (256-bit key)
    out = cipher.salsa20(bytes(64), bytes([0x80]) + bytes(31), bytes(8))
    assert out.hex().startswith("e3be8fdd8beca2e3ea8ef9475b29a6e7003951e1097a5c38d23b7a5fad9f6844")


def test_encrypted_blocks():
    key, text = bytes(range(16)), b"some text" * 20
    nonce = bytes([1 ^ 5, 2, 3, 4, 0, 0, 0, 0])
    data = bytes([8]) + (7).to_bytes(8, "little") + bytes([4, 1, 2, 3, 4]) + b"S" + cipher.salsa20(text, key, nonce)
    assert cipher.decrypt_block(data, 5, {7: key}) == text
    for bad in (b"", b"\x03", data[:10], data.replace(b"\x04S", b"\x04A", 1)):
        with pytest.raises(ValueError):
            cipher.decrypt_block(bad, 5, {7: key})
    with pytest.raises(ValueError):
        cipher.decrypt_block(data, 5, {})


def test_few_lines_and_many_decode_alike(monkeypatch):
    r = np.random.default_rng(5)
    for _ in range(20):
        runs = r.integers(0, 256, 400, dtype=np.uint8).tobytes()
        starts = np.sort(r.integers(0, 400, 12)).astype("<u2") + 24
        data = np.array([1, 30, 12], "<u2").tobytes() + bytes(4) + (14).to_bytes(4, "little") + starts.tobytes() + runs
        decoded = []
        for few in (0, 1 << 30):
            monkeypatch.setattr(grp, "FEW_LINES", few)
            decoded.append(np.stack(grp.parse(data).frames))
        assert np.array_equal(*decoded)
