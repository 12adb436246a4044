"""Image formats: round trips, and strips as other writers make them."""

import struct
import zlib

import numpy as np
import pytest

from roadweft.sources import codecs


@pytest.mark.parametrize("kind", ["uint8", "uint16", "float32"])
@pytest.mark.parametrize("shape", [(1, 1, 1), (8, 300, 17), (3, 256, 5)])
def test_tiff_round_trip(kind, shape):
    bands = (np.random.default_rng(1).random(shape) * 255).astype(kind)
    got, geo = codecs.read_tiff(codecs.write_tiff(bands, geo=(10.5, 20.0, 0.3, -0.3)))
    assert got.dtype == bands.dtype and (got == bands).all() and geo == (10.5, 20.0, 0.3, -0.3)
    assert codecs.read(codecs.write_tiff(bands, nodata=None))[1] is None


def lzw(data):
    """Reference encoder: codes high bits first, wider from the code after entries 511, 1023 and 2047 on; a new table after entry 4094."""
    bits, table, width, word = [], {}, 9, b""

    def put(code):
        bits.extend(code >> k & 1 for k in range(width - 1, -1, -1))

    put(256)
    table = {bytes([k]): k for k in range(256)}
    following = 258
    for byte in data:
        longer = word + bytes([byte])
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = following
        following += 1
        word = bytes([byte])
        if following == 4095:
            put(256)
            table, following, width = {bytes([k]): k for k in range(256)}, 258, 9
        elif following in (512, 1024, 2048):
            width += 1
    if word:
        put(table[word])
        following += 1
        if following in (512, 1024, 2048):
            width += 1
    put(257)
    bits += [0] * (-len(bits) % 8)
    return bytes(int("".join(map(str, bits[k : k + 8])), 2) for k in range(0, len(bits), 8))


@pytest.mark.parametrize("size", [0, 1, 300, 5000, 60000])
def test_lzw(size):
    data = np.random.default_rng(2).integers(0, 7, size).astype(np.uint8).tobytes()
    assert codecs._unlzw(lzw(data)) == data


def test_pixels_in_turn_with_predictor_big_endian():
    image = np.random.default_rng(3).integers(0, 256, (4, 6, 3)).astype(np.uint8)
    packed = zlib.compress(np.diff(image, axis=1, prepend=np.zeros((4, 1, 3), np.uint8)).astype(np.uint8).tobytes())
    short = lambda tag, value: struct.pack(">HHIHH", tag, 3, 1, value, 0)
    long = lambda tag, value: struct.pack(">HHII", tag, 4, 1, value)
    tags = [long(256, 6), long(257, 4), short(258, 8), short(259, 8), long(273, 8), short(277, 3), long(278, 4), long(279, len(packed)), short(284, 1), short(317, 2)]
    data = b"MM\0*" + struct.pack(">I", 8 + len(packed)) + packed + struct.pack(">H", len(tags)) + b"".join(tags) + b"\0" * 4
    assert (codecs.read_tiff(data)[0] == image.transpose(2, 0, 1)).all()


@pytest.mark.parametrize("count", [1, 3, 4])
def test_png_round_trip(count):
    bands = np.random.default_rng(4).integers(0, 256, (count, 9, 7)).astype(np.uint8)
    assert (codecs.read(codecs.write_png(bands))[0] == bands).all()


@pytest.mark.parametrize("method", [0, 1, 2, 3, 4])
def test_png_filters(method):
    image = np.random.default_rng(5).integers(0, 256, (5, 4, 3)).astype(int)
    flat = np.zeros((6, 15), int)
    flat[1:, 3:] = image.reshape(5, 12)
    here, left, up, corner = flat[1:, 3:], flat[1:, :-3], flat[:-1, 3:], flat[:-1, :-3]
    p = left + up - corner
    nearest = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
    guess = [0 * here, left, up, (left + up) // 2, nearest][method]
    lines = np.concatenate([np.full((5, 1), method), (here - guess) % 256], 1).astype(np.uint8)
    data = codecs.write_png(image.astype(np.uint8).transpose(2, 0, 1))
    at = data.index(b"IDAT") - 4
    packed = zlib.compress(lines.tobytes())
    data = data[:at] + struct.pack(">I", len(packed)) + b"IDAT" + packed + b"\0" * 4
    assert (codecs.read_png(data) == image.transpose(2, 0, 1)).all()


def test_other_bytes_are_errors():
    with pytest.raises(ValueError):
        codecs.read(b"GIF89a, say")
