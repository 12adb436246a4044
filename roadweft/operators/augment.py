"""Colour augmentations of whole 8-bit images (y, x, 3): blur, shifts of channels and of hue, contrast
limited by tiles, filters. Published methods in numpy; they run per image."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: sRGB to XYZ under D65, and its white (fixed values).
XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
WHITE = np.array([0.950456, 1.0, 1.088754])
EDGE = (6 / 29) ** 3


def box_blur(image: np.ndarray, size: int) -> np.ndarray:
    """Mean over a square window, borders mirrored without the edge, rounded."""
    before, after = size // 2, (size - 1) // 2
    padded = np.pad(image.astype(float), ((before, after), (before, after), (0, 0)), mode="reflect")
    return np.rint(np.lib.stride_tricks.sliding_window_view(padded, (size, size), axis=(0, 1)).mean((-1, -2))).astype(np.uint8)


def shift_channels(image: np.ndarray, *by: int) -> np.ndarray:
    return np.clip(image.astype(int) + np.array(by), 0, 255).astype(np.uint8)


def to_hsv(image: np.ndarray) -> np.ndarray:
    """Hue 0 to 180 (half degrees), saturation and value 0 to 255."""
    r, g, b = np.moveaxis(image.astype(float), -1, 0)
    v, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    c = v - low
    safe = np.where(c == 0, 1, c)
    h = np.where(v == r, 30 * (g - b) / safe, np.where(v == g, 60 + 30 * (b - r) / safe, 120 + 30 * (r - g) / safe))
    h = np.where(c == 0, 0, np.where(h < 0, h + 180, h))
    return np.rint(np.stack([h % 180, np.where(v == 0, 0, 255 * c / np.where(v == 0, 1, v)), v], -1))


def from_hsv(hsv: np.ndarray) -> np.ndarray:
    h, s, v = hsv[..., 0] / 30, hsv[..., 1] / 255, hsv[..., 2]
    rgb = [v * (1 - s * np.clip(np.minimum(k, 4 - k), 0, 1)) for k in ((n + h) % 6 for n in (5, 3, 1))]
    return np.clip(np.rint(np.stack(rgb, -1)), 0, 255).astype(np.uint8)


def shift_hsv(image: np.ndarray, hue: int, saturation: int, value: int) -> np.ndarray:
    """Hue turned, saturation and value shifted within their ranges."""
    hsv = to_hsv(image)
    return from_hsv(np.stack([(hsv[..., 0] + hue) % 180, np.clip(hsv[..., 1] + saturation, 0, 255), np.clip(hsv[..., 2] + value, 0, 255)], -1))


def to_lab(image: np.ndarray) -> np.ndarray:
    """CIE L*a*b* of an sRGB image, L from 0 to 100."""
    c = image / 255.0
    linear = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    t = linear @ XYZ.T / WHITE
    f = np.where(t > EDGE, np.cbrt(t), t * 841 / 108 + 4 / 29)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    y = (lab[..., 0] + 16) / 116
    f = np.stack([y + lab[..., 1] / 500, y, y - lab[..., 2] / 200], -1)
    t = np.where(f > 6 / 29, f**3, (f - 4 / 29) * 108 / 841)
    linear = np.clip(t * WHITE @ np.linalg.inv(XYZ).T, 0, 1)
    return np.clip(np.rint(255 * np.where(linear > 0.0031308, 1.055 * linear ** (1 / 2.4) - 0.055, 12.92 * linear)), 0, 255).astype(np.uint8)


def limited_contrast(band: np.ndarray, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation of an 8-bit band: per tile a histogram whose
    peaks over ``clip`` times the mean are spread over all values, and between tiles' middles the
    mappings blended bilinearly. The band is mirrored to a whole number of tiles."""
    h, w = band.shape
    th, tw = -(-h // grid), -(-w // grid)
    whole = np.pad(band, ((0, th * grid - h), (0, tw * grid - w)), mode="symmetric")
    tiles = whole.reshape(grid, th, grid, tw).transpose(0, 2, 1, 3).reshape(grid * grid, -1)
    counts = np.stack([np.bincount(t, minlength=256) for t in tiles]).astype(float)
    most = max(1.0, clip * th * tw / 256)
    over = np.maximum(counts - most, 0).sum(1, keepdims=True)
    counts = np.minimum(counts, most) + over / 256
    maps = np.rint(np.cumsum(counts, 1) * 255 / (th * tw)).reshape(grid, grid, 256)
    places = lambda n, size: np.clip((np.arange(n) + 0.5) / size - 0.5, 0, grid - 1)
    y, x = places(h, th), places(w, tw)
    y0, x0 = np.minimum(y.astype(int), grid - 2 if grid > 1 else 0), np.minimum(x.astype(int), grid - 2 if grid > 1 else 0)
    y1, x1 = np.minimum(y0 + 1, grid - 1), np.minimum(x0 + 1, grid - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    at = lambda a, b: maps[a[:, None], b[None], band]
    blend = (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x1)) + fy * ((1 - fx) * at(y1, x0) + fx * at(y1, x1))
    return np.clip(np.rint(blend), 0, 255).astype(np.uint8)


def clahe(image: np.ndarray, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """`limited_contrast` of the lightness alone."""
    lab = to_lab(image)
    light = limited_contrast(np.rint(lab[..., 0] * 2.55).astype(np.uint8), clip, grid)
    return from_lab(np.concatenate([light[..., None] / 2.55, lab[..., 1:]], -1))


def sharpen(image: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """What a blur takes away, added again."""
    return np.clip(np.rint(image + strength * (image.astype(float) - box_blur(image, 3))), 0, 255).astype(np.uint8)


FILTERS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"blur": lambda i: box_blur(i, 3), "sharpen": sharpen, "clahe": clahe}


def random_filter(image: np.ndarray, draw: int) -> np.ndarray:
    """One of FILTERS, by a number drawn elsewhere, so that reruns agree."""
    return FILTERS[sorted(FILTERS)[draw % len(FILTERS)]](image)
