"""TIFF and PNG of 8-bit, 16-bit and float bands, by the published formats, in numpy and zlib."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Tags and types of TIFF (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, EXTRA, FORMAT, SCALE, TIEPOINT, NODATA = (
    256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 338, 339, 33550, 33922, 42113,
)
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
PNG = b"\x89PNG\r\n\x1a\n"


def write_tiff(bands: np.ndarray, nodata: int | None = 0, geo: tuple[float, float, float, float] | None = None, rows: int = 256) -> bytes:
    """A TIFF of ``bands`` (band, y, x), deflated in strips, band after band; ``geo`` is (x0, y0,
    pixel width, pixel height), the height negative for images that face north."""
    bands = np.ascontiguousarray(bands).astype(bands.dtype.newbyteorder("<"))
    count, height, width = bands.shape
    strips = [zlib.compress(band[y : y + rows].tobytes()) for band in bands for y in range(0, height, rows)]
    places = (8 + np.cumsum([0] + [len(s) for s in strips])).tolist()
    kind = {"u": 1, "i": 2, "f": 3}[bands.dtype.kind]
    tags = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [bands.itemsize * 8] * count), (COMPRESSION, 3, [8]), (PHOTOMETRIC, 3, [1]),
        (OFFSETS, 4, places[:-1]), (SAMPLES, 3, [count]), (ROWS, 4, [rows]), (COUNTS, 4, [len(s) for s in strips]), (PLANAR, 3, [2]),
        (FORMAT, 3, [kind] * count),
    ]
    if count > 1:
        tags.append((EXTRA, 3, [0] * (count - 1)))
    if geo:
        tags += [(SCALE, 12, [geo[2], -geo[3], 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, geo[0], geo[1], 0.0])]
    if nodata is not None:
        tags.append((NODATA, 2, [f"{nodata}\0".encode()]))
    tags.sort()
    start = places[-1] + places[-1] % 2
    tail = start + 2 + 12 * len(tags) + 4
    entries, more = b"", b""
    for tag, code, values in tags:
        data = values[0] if code == 2 else struct.pack(f"<{len(values)}{TYPES[code]}", *values)
        size = len(data) if code == 2 else len(values)
        if len(data) > 4:
            place, more = struct.pack("<I", tail + len(more)), more + data + b"\0" * (len(data) % 2)
        else:
            place = data.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, code, size) + place
    body = b"".join(strips)
    return b"II*\0" + struct.pack("<I", start) + body + b"\0" * (places[-1] % 2) + struct.pack("<H", len(tags)) + entries + b"\0" * 4 + more


def _unlzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes of 9 to 12 bits, high bits first, widened one code early."""
    out, table, before = bytearray(), [], b""
    bits, held, width = 0, 0, 9
    for byte in data:
        bits, held = (bits << 8 | byte) & 0xFFFFFF, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, before, width = [bytes([k]) for k in range(256)] + [b"", b""], b"", 9
            continue
        if code < len(table):
            entry = table[code]
        elif before:
            entry = before + before[:1]
        else:
            raise ValueError("corrupt LZW data")
        out += entry
        if before:
            table.append(before + entry[:1])
        before = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


def read_tiff(data: bytes) -> tuple[np.ndarray, tuple[float, float, float, float] | None]:
    """(bands as (band, y, x), geo) of the first image of a striped TIFF: plain, LZW or deflate."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    (at,) = struct.unpack(order + "I", data[4:8])
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for k in range(n):
        tag, code, size = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if code in TYPES:
            form = f"{order}{size}{TYPES[code]}"
            place = at + 10 + 12 * k
            if struct.calcsize(form) > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            tags[tag] = struct.unpack_from(form, data, place)
    if OFFSETS not in tags:
        raise ValueError("tiled TIFFs are not read")
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, count, planar = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(PLANAR, 1)
    kind = np.dtype(f"{order}{'uif'[one(FORMAT, 1) - 1]}{one(BITS, 8) // 8}")
    unpack = {1: bytes, 5: _unlzw, 8: zlib.decompress, 32946: zlib.decompress}.get(one(COMPRESSION, 1))
    if unpack is None:
        raise ValueError(f"compression {one(COMPRESSION, 1)} is not read")
    rows = min(one(ROWS, height), height)
    across = 1 if planar == 2 else count
    parts = []
    for k, (place, size) in enumerate(zip(tags[OFFSETS], tags[COUNTS])):
        high = min(rows, height - k % -(-height // rows) * rows)
        part = np.frombuffer(unpack(data[place : place + size]), kind, high * width * across).reshape(high, width, across)
        if one(PREDICTOR, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=kind)
        parts.append(part)
    whole = np.concatenate(parts).reshape(-1, height, width, across) if parts else np.zeros((count, height, width, 1), kind)
    bands = whole[..., 0] if planar == 2 else whole[0].transpose(2, 0, 1)
    geo = None
    if SCALE in tags and TIEPOINT in tags:
        (sx, sy), (i, j, _, x, y) = tags[SCALE][:2], tags[TIEPOINT][:5]
        geo = (x - i * sx, y + j * sy, sx, -sy)
    return np.ascontiguousarray(bands).astype(kind.newbyteorder("=")), geo


def write_png(bands: np.ndarray) -> bytes:
    """A PNG of one, three or four 8-bit bands (band, y, x)."""
    count, height, width = bands.shape
    color = {1: 0, 3: 2, 4: 6}[count]
    lines = np.zeros((height, 1 + width * count), np.uint8)
    lines[:, 1:] = bands.transpose(1, 2, 0).reshape(height, -1)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """Bands (band, y, x) of a PNG of 8-bit samples without palette and interlacing."""
    if data[:8] != PNG:
        raise ValueError("not a PNG")
    at, packed = 8, b""
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        name, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            width, height, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            packed += body
        at += 12 + size
    if depth != 8 or color == 3 or interlaced:
        raise ValueError("only 8-bit samples, neither palettes nor interlacing")
    count = {0: 1, 2: 3, 4: 2, 6: 4}[color]
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * count)
    out = np.zeros((height, width * count), np.uint8)
    above = np.zeros(width * count, np.uint8)
    for y, (method, *_), row in zip(range(height), lines[:, :1].tolist(), lines[:, 1:]):
        if method == 0:
            now = row
        elif method == 1:
            now = np.cumsum(row.reshape(width, count), axis=0, dtype=np.uint8).ravel()
        elif method == 2:
            now = row + above
        else:
            now = row.tolist()
            for x in range(len(now)):
                a, b, c = (now[x - count] if x >= count else 0), int(above[x]), (int(above[x - count]) if x >= count else 0)
                guess = (a + b) // 2 if method == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                now[x] = (now[x] + guess) & 255
        out[y] = above = np.asarray(now, np.uint8)
    return out.reshape(height, width, count).transpose(2, 0, 1)


def read(data: bytes) -> tuple[np.ndarray, tuple[float, float, float, float] | None]:
    return (read_png(data), None) if data[:8] == PNG else read_tiff(data)
