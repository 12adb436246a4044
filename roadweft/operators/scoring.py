"""Batched scoring of images by a supplied model, with flips averaged and the border cut."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from roadweft.sources import codecs

#: A model: images (n, bands, y, x) of floats to scores (n, channels, y, x) of 0 to 1.
Scorer = Callable[[np.ndarray], np.ndarray]


def with_flips(scorer: Scorer, images: np.ndarray, flips: int) -> np.ndarray:
    """Mean score of the images and of their flips, turned back: none, left-right (1), also upside down
    and both (2)."""
    axes = ([], [3], [2], [2, 3])[: (1, 2, 4)[flips]]
    return np.mean([np.flip(scorer(np.ascontiguousarray(np.flip(images, a))), a) for a in axes], axis=0)


def score(images: DataFrame, load: Callable[[], Scorer], batch: int = 4, flips: int = 0, border: int = 0, fold: int | None = None) -> DataFrame:
    """(name, content): 8-bit TIFFs of the scores times 255 of images (name, content), as
    fold<k>_<name>.tif where a fold is given. ``load`` makes the model once per task. Images are
    padded by ``border`` mirrored pixels, of which the scores are cut again; ``batch`` images of one
    size are scored at a time. Files that are no TIFF or PNG are errors; an empty table gives none."""
    prefix = "" if fold is None else f"fold{fold}_"

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, held = load(), {}

        def done(shape: tuple) -> pd.DataFrame:
            names, stack = zip(*held.pop(shape))
            found = with_flips(scorer, np.stack(stack), flips)
            inner = found[:, :, border : found.shape[2] - border, border : found.shape[3] - border]
            files = [codecs.write_tiff((image * 255).astype(np.uint8)) for image in inner]
            return pd.DataFrame({"name": [f"{prefix}{n.rsplit('.', 1)[0]}.tif" for n in names], "content": files})

        for rows in batches:
            for name, content in zip(rows["name"], rows.content):
                image = codecs.read(bytes(content))[0].astype(np.float32)
                padded = np.pad(image, ((0, 0), (border, border), (border, border)), mode="reflect") if border else image
                held.setdefault(padded.shape, []).append((name, padded))
                if len(held[padded.shape]) == batch:
                    yield done(padded.shape)
        for shape in list(held):
            yield done(shape)

    return images.select("name", "content").mapInPandas(step, "name string, content binary")
