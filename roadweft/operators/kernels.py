"""Raster kernels on whole images, run per image through applyInPandas: thinning, areas, morphology,
blur, skeleton graphs, and line simplification."""

from __future__ import annotations

import numpy as np

from roadweft.operators.components import labelled

#: Offsets of the eight neighbours, clockwise from above.
RING = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def _shifted(mask: np.ndarray, fill: int = 0) -> list[np.ndarray]:
    padded = np.pad(mask, 1, constant_values=fill)
    h, w = mask.shape
    return [padded[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in RING]


def _thinnable() -> np.ndarray:
    """Per step of `thin` whether a pixel leaves, by its neighbours as bits in the order of RING."""
    ring = (np.arange(256)[None] >> np.arange(8)[:, None]) & 1
    count = ring.sum(0)
    turns = ((ring == 0) & (np.roll(ring, -1, 0) == 1)).sum(0)
    n, e, s, w = ring[0], ring[2], ring[4], ring[6]
    free = np.stack([((n & e & s) == 0) & ((e & s & w) == 0), ((n & e & w) == 0) & ((n & s & w) == 0)])
    return (count >= 2) & (count <= 6) & (turns == 1) & free


def thin(mask: np.ndarray) -> np.ndarray:
    """One-pixel skeleton by the published two-step parallel thinning of Zhang and Suen."""
    padded, leaves = np.pad(mask.astype(np.uint8), 1), _thinnable()
    h, w = mask.shape
    now = padded[1:-1, 1:-1]
    while True:
        changed = False
        for step in (0, 1):
            code = np.zeros((h, w), np.uint8)
            for k, (dy, dx) in enumerate(RING):
                code |= padded[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] << k
            drop = (now == 1) & leaves[step][code]
            if drop.any():
                now[drop] = 0
                changed = True
        if not changed:
            return now.copy()


def areas(mask: np.ndarray, corners: bool = False) -> np.ndarray:
    """Numbers of connected areas in the order of their first pixels, 0 for background; by edges, or
    by corners too."""
    on = np.asarray(mask) > 0
    place = np.arange(on.size).reshape(on.shape)
    pairs = [(place[on], place[on])]
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1))[: 4 if corners else 2]:
        here = (slice(0, on.shape[0] - dy), slice(max(0, -dx), on.shape[1] - max(0, dx)))
        there = (slice(dy, on.shape[0]), slice(max(0, dx), on.shape[1] - max(0, -dx)))
        both = on[here] & on[there]
        pairs.append((place[here][both], place[there][both]))
    nodes, first = labelled(*(np.concatenate(x) for x in zip(*pairs)))
    out = np.zeros(on.size, np.int64)
    out[nodes] = np.unique(first, return_inverse=True)[1] + 1
    return out.reshape(on.shape)


def open_areas(mask: np.ndarray, least: int) -> np.ndarray:
    """Drop areas, and fill holes, of fewer than ``least`` pixels."""
    for value in (1, 0):
        part = areas(mask == value)
        sizes = np.bincount(part.ravel())
        mask = np.where((part > 0) & (sizes[part] < least), 1 - value, mask)
    return mask.astype(np.uint8)


def dilate(mask: np.ndarray, size: int) -> np.ndarray:
    """Maximum over a square window of odd ``size``."""
    r = size // 2
    padded = np.pad(mask, r)
    return np.lib.stride_tricks.sliding_window_view(padded, (size, size)).max((2, 3))


def erode(mask: np.ndarray, size: int) -> np.ndarray:
    r = size // 2
    padded = np.pad(mask, r, constant_values=mask.max(initial=0))
    return np.lib.stride_tricks.sliding_window_view(padded, (size, size)).min((2, 3))


def close_then_open(mask: np.ndarray, close: int = 7, open_: int = 7) -> np.ndarray:
    closed = erode(dilate(mask, close), close)
    return dilate(erode(closed, open_), open_)


def blur(image: np.ndarray, size: int = 7) -> np.ndarray:
    """Separable Gaussian blur, borders mirrored without repeating the edge; sigma follows the
    usual rule 0.3 ((size - 1) / 2 - 1) + 0.8."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    at = np.arange(size) - size // 2
    weights = np.exp(-(at**2) / (2 * sigma**2))
    weights /= weights.sum()
    padded = np.pad(image.astype(float), size // 2, mode="reflect")
    rows = np.lib.stride_tricks.sliding_window_view(padded, size, axis=0) @ weights
    return np.lib.stride_tricks.sliding_window_view(rows, size, axis=1) @ weights


def distances(mask: np.ndarray) -> np.ndarray:
    """Distance of every pixel to the nearest background pixel; beyond the image is no background."""
    far = float(sum(mask.shape)) ** 2
    best = np.where(mask > 0, far, 0.0)
    for _ in range(2):  # columns, then rows: least squared distance along the line
        n = best.shape[0]
        apart = (np.arange(n)[:, None] - np.arange(n)[None]) ** 2.0
        best = np.stack([(apart + best[:, x]).min(1) for x in range(best.shape[1])], 1).T
    return np.sqrt(best)


def medial_axis(mask: np.ndarray) -> np.ndarray:
    """One-pixel ridge of the distance to the background: pixels leave from the rim inwards, by
    distance, those in corners last, unless one is an end or its neighbours would come apart."""
    now = np.pad((np.asarray(mask) > 0).astype(np.uint8), 1)
    near = np.pad(distances(now[1:-1, 1:-1]), 1)
    ys, xs = np.nonzero(now)
    crowd = sum(r.astype(int) for r in _shifted(now))
    for k in np.lexsort((np.arange(len(ys)), -crowd[ys, xs], near[ys, xs])):
        y, x = ys[k], xs[k]
        ring = [int(now[y + dy, x + dx]) for dy, dx in RING]
        if sum(ring) < 2:
            continue
        # groups of neighbours that touch by edges or corners around the pixel
        groups = sum(not a and not (b and edge) and c for a, b, c, edge in [(ring[i - 1], ring[i - 2], ring[i], i % 2 == 0) for i in range(8)])
        if groups <= 1 and not all(ring[::2]):
            now[y, x] = 0
    return now[1:-1, 1:-1]


def simplify_line(points: np.ndarray, epsilon: float) -> np.ndarray:
    """Ramer-Douglas-Peucker with an explicit stack; the farthest point splits if it is at least
    ``epsilon`` from the infinite line through the ends (from the point, where they coincide)."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        inner, chord = points[a + 1 : b] - points[a], points[b] - points[a]
        length = np.hypot(*chord)
        far = np.abs(inner[:, 0] * chord[1] - inner[:, 1] * chord[0]) / length if length else np.hypot(inner[:, 0], inner[:, 1])
        k = int(far.argmax())
        if far[k] >= epsilon:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def skeleton_paths(skeleton: np.ndarray) -> tuple[list[tuple[float, float]], list[tuple[int, int, np.ndarray]]]:
    """(nodes as centres of their pixels, edges as (node, node, pixels from end to end)) of a skeleton.

    Pixels with exactly two neighbours belong to edges, others to nodes; touching node pixels are
    one node. A closed ring has no node pixel, hence neither nodes nor edges."""
    count = sum(r.astype(int) for r in _shifted(skeleton))
    node = areas((skeleton == 1) & (count != 2), corners=True)
    nodes = [tuple(float(c.mean()) for c in np.nonzero(node == k)) for k in range(1, node.max(initial=0) + 1)]
    path = (skeleton == 1) & (count == 2)
    seen = np.zeros(skeleton.shape, bool)
    inside = lambda y, x: 0 <= y < skeleton.shape[0] and 0 <= x < skeleton.shape[1]
    edges = []
    for start in zip(*np.nonzero(node)):
        for dy, dx in RING:
            y, x = start[0] + dy, start[1] + dx
            if not inside(y, x) or not path[y, x] or seen[y, x]:
                continue
            pixels, at = [start], (y, x)
            while path[at]:
                seen[at] = True
                ahead = [(at[0] + a, at[1] + b) for a, b in RING if inside(at[0] + a, at[1] + b) and skeleton[at[0] + a, at[1] + b] and (at[0] + a, at[1] + b) != pixels[-1]]
                fresh = [p for p in ahead if node[p]] or [p for p in ahead if not seen[p]]
                if not fresh:
                    break
                pixels.append(at)
                at = fresh[0]
            if node[at]:
                edges.append((int(node[start]) - 1, int(node[at]) - 1, np.array([*pixels, at])))
    return nodes, edges


def path_length(points: np.ndarray) -> float:
    return float(np.hypot(*np.diff(points, axis=0).T).sum())


def skeleton_graph(skeleton: np.ndarray) -> tuple[list[tuple[float, float]], list[tuple[int, int, float]]]:
    """(nodes, edges as (node, node, length)) of a skeleton."""
    nodes, edges = skeleton_paths(skeleton)
    return nodes, [(u, v, path_length(pixels)) for u, v, pixels in edges]
