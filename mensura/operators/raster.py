"""Raster kernels on numpy: components of a colour in rendered pages, and the choice among them in plain Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COMPONENTS = "image_id long, component int, pixels long, x0 int, y0 int, x1 int, y1 int"


def label_components(mask: np.ndarray) -> np.ndarray:
    """Numbers (from 1) of the 4-connected components of a boolean image, in the order of their first pixel."""
    h, w = mask.shape
    flat = np.zeros((h, w + 2), np.int8)
    flat[:, 1:-1] = mask
    step = np.diff(flat, axis=1)
    row, start = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    parent = np.arange(len(row))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if start[i] < end[j] and start[j] < end[i]:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(i) for i in range(len(row))], int)
    names = np.cumsum(roots == np.arange(len(row))) if len(row) else roots
    out = np.zeros((h, w), int)
    for k in range(len(row)):
        out[row[k], start[k] : end[k]] = names[roots[k]]
    return out


def dominant_rgb(rgb: np.ndarray, mask: np.ndarray) -> tuple[int, int, int] | None:
    """The most frequent colour under a mask, of equally frequent ones the smallest."""
    some = rgb[mask].astype(np.int64)
    if not len(some):
        return None
    keys, counts = np.unique((some[:, 0] << 16) | (some[:, 1] << 8) | some[:, 2], return_counts=True)
    best = int(keys[np.argmax(counts)])
    return best >> 16, (best >> 8) & 255, best & 255


def colour_components(images: DataFrame, rgb: tuple[int, int, int], tolerance: int = 5) -> DataFrame:
    """Components of pixels near a colour in images(image_id, width, height, rgb: binary), one row each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                image = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)
                labels = label_components((np.abs(image.astype(int) - rgb) <= tolerance).all(axis=2))
                y, x = np.nonzero(labels)
                of = labels[y, x]
                for k in range(1, int(labels.max(initial=0)) + 1):
                    mine = of == k
                    rows.append((r.image_id, k, int(mine.sum()), int(x[mine].min()), int(y[mine].min()), int(x[mine].max()) + 1, int(y[mine].max()) + 1))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in COMPONENTS.split(", ")])

    return images.mapInPandas(run, COMPONENTS)


def retained(components: DataFrame, share: float = 0.015, most: float | None = None) -> DataFrame:
    """The largest plausible component of each image and those of at least ``share`` of it."""
    plausible = components if most is None else components.where(F.col("pixels") <= most)
    w = Window.partitionBy("image_id")
    return plausible.withColumn("largest", F.max("pixels").over(w)).where(F.col("pixels") >= F.col("largest") * share).withColumn("chosen", F.col("pixels") == F.col("largest"))
