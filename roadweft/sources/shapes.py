"""Shapefiles of lines with attributes: .shp, .shx and .dbf as bytes, by the published format."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np

#: Fixed values of the format: file code, version, and the type of lines.
CODE, VERSION, LINES = 9994, 1000, 3
TEXT_WIDTH = 254

Points = Sequence[tuple[float, float]]


def header(size: int, box: Sequence[float]) -> bytes:
    """Of a .shp or .shx of ``size`` bytes whose points lie in ``box`` (x, y, x, y)."""
    return struct.pack(">7i", CODE, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i", VERSION, LINES) + struct.pack("<4d", *box) + bytes(32)


#: What stands before a record's points.
_RECORD = np.dtype([("number", ">i4"), ("words", ">i4"), ("kind", "<i4"), ("box", "<f8", 4), ("parts", "<i4"), ("points", "<i4"), ("first", "<i4")])
_WALK = struct.Struct(">4xi")
_COUNTS = struct.Struct("<i32x2i")


def records(xy: np.ndarray, counts: np.ndarray, number: int = 0, at: int = 100) -> tuple[bytes, bytes]:
    """(.shp, .shx) without headers of lines of ``counts`` points each, all points in a row (x, y); the
    first has ``number`` lines and ``at`` bytes before it."""
    sizes = _RECORD.itemsize + 16 * counts
    ends = np.cumsum(sizes)
    begin, first = ends - sizes, np.cumsum(counts) - counts
    out = np.empty(int(sizes.sum()), np.uint8)
    for n in np.unique(counts).tolist():
        own = np.flatnonzero(counts == n)
        heads = np.zeros(len(own), _RECORD)
        points = xy[first[own][:, None] + np.arange(n)].astype("<f8")
        heads["number"], heads["words"], heads["kind"], heads["parts"], heads["points"] = number + own + 1, (_RECORD.itemsize - 8 + 16 * n) // 2, LINES, 1, n
        if n:
            heads["box"] = np.concatenate([points.min(1), points.max(1)], 1)
        whole = np.concatenate([heads.view(np.uint8).reshape(len(own), -1), np.ascontiguousarray(points).view(np.uint8).reshape(len(own), -1)], 1)
        out[begin[own][:, None] + np.arange(whole.shape[1])] = whole
    index = np.stack([(at + begin) // 2, (sizes - 8) // 2], 1).astype(">i4")
    return out.tobytes(), index.tobytes()


def table_head(names: Sequence[str], n: int) -> bytes:
    """Of a .dbf of ``n`` rows; names are cut to ten characters."""
    head = struct.pack("<4BIHH20x", 3, 70, 1, 1, n, 33 + 32 * len(names), 1 + TEXT_WIDTH * len(names))
    return head + b"".join(name.encode()[:10].ljust(11, b"\0") + b"C" + bytes(4) + bytes([TEXT_WIDTH]) + bytes(15) for name in names) + b"\r"


def table_rows(columns: Sequence[Sequence[object]], n: int) -> bytes:
    """Rows of a .dbf, values as text."""
    texts = [[str(v if v is not None else "").encode()[:TEXT_WIDTH].ljust(TEXT_WIDTH) for v in column] for column in columns]
    return b"".join(b" " + b"".join(row) for row in zip(*texts)) if columns else b" " * n


def write_lines(lines: Sequence[Points], attributes: Sequence[dict[str, object]]) -> tuple[bytes, bytes, bytes]:
    """(.shp, .shx, .dbf) of lines and their attributes, all of which have the keys of the first; names
    are cut to ten characters, values are written as text."""
    xy = np.array([p for line in lines for p in line], float).reshape(-1, 2)
    shp, shx = records(xy, np.array([len(line) for line in lines], np.int64))
    box = (*xy.min(0), *xy.max(0)) if len(xy) else (0.0,) * 4
    names = list(attributes[0]) if attributes else []
    rows = table_rows([[row[n] for row in attributes] for n in names], len(attributes))
    return header(100 + len(shp), box) + shp, header(100 + len(shx), box) + shx, table_head(names, len(lines)) + rows + b"\x1a"


def read_records(shp: bytes, at: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points of all parts in a row, points per part, parts per record) of ``count`` records from ``at``;
    what is no line has no parts."""
    runs, lengths, parts = [], [], []
    for _ in range(count):
        size = 8 + 2 * _WALK.unpack_from(shp, at)[0]
        if struct.unpack_from("<i", shp, at + 8)[0] == LINES:
            _, n, points = _COUNTS.unpack_from(shp, at + 8)
            start = at + 52 + 4 * n
            runs.append(shp[start : start + 16 * points])
            if n == 1 and shp[at + 52 : at + 56] == b"\0\0\0\0":
                lengths.append(points)
            else:
                first = [*struct.unpack_from(f"<{n}i", shp, at + 52), points]
                lengths += [b - a for a, b in zip(first, first[1:])]
            parts.append(n)
        else:
            parts.append(0)
        at += size
    return np.frombuffer(b"".join(runs), "<f8").reshape(-1, 2), np.array(lengths, np.int64), np.array(parts, np.int64)


def read_head(dbf: bytes) -> tuple[int, int, list[tuple[str, int]]]:
    """(where rows start, bytes of a row, (name, bytes) of the fields)."""
    start, width = struct.unpack_from("<HH", dbf, 8)
    return start, width, [(dbf[k : k + 11].split(b"\0")[0].decode(), dbf[k + 16]) for k in range(32, start - 1, 32)]


def read_rows(dbf: bytes, start: int, count: int, width: int, fields: list[tuple[str, int]]) -> list[list[str]]:
    """The columns of ``count`` rows from ``start``."""
    out, place = [], start + 1
    for _, size in fields:
        out.append([dbf[a : a + size].decode(errors="replace").strip() for a in range(place, place + count * width, width)])
        place += size
    return out


def read_lines(shp: bytes, dbf: bytes) -> list[tuple[list[list[tuple[float, float]]], dict[str, str]]]:
    """(parts, attributes) of every record; what is no line has no parts."""
    count = struct.unpack_from("<I", dbf, 4)[0]
    start, width, fields = read_head(dbf)
    xy, lengths, parts = read_records(shp, 100, count)
    lines = iter(np.split(xy, np.cumsum(lengths)[:-1]) if len(lengths) else [])
    rows = list(zip(*read_rows(dbf, start, count, width, fields))) if fields else [()] * count
    return [([list(map(tuple, next(lines).tolist())) for _ in range(n)], dict(zip([f[0] for f in fields], row))) for n, row in zip(parts, rows)]
