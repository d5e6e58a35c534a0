"""Operators on pages as pixel arrays (ARRAY<INT> with width and height): one row is one page, as NumPy in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def otsu(values: np.ndarray) -> int:
    """The grey level that parts a page best, by the variance between the classes."""
    n = np.bincount(values.ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = (mass[-1] * below / below[-1] - mass) ** 2 / (below * above)
    return int(np.nan_to_num(apart, nan=-1, posinf=-1).argmax())


def ink(page: np.ndarray) -> np.ndarray:
    return page <= otsu(page)


def runs(hit: np.ndarray, max_gap: int = 0) -> list[tuple[int, int]]:
    """Half-open runs of true values; gaps of up to ``max_gap`` are bridged."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    spans = edge.reshape(-1, 2)
    if not len(spans):
        return []
    keep = np.concatenate([[True], spans[1:, 0] - spans[:-1, 1] > max_gap])
    at = np.flatnonzero(keep)
    return [(int(spans[a, 0]), int(spans[b - 1, 1])) for a, b in zip(at, [*at[1:], len(spans)], strict=True)]


def text_lines(page: np.ndarray, least_ink: int = 1, max_gap: int = 1, least_height: int = 2) -> list[tuple[int, int, int, int]]:
    """Boxes of lines by the ink in each row of pixels."""
    dark = ink(page)
    out = []
    for top, bottom in runs(dark.sum(axis=1) >= least_ink, max_gap):
        if bottom - top >= least_height:
            columns = np.flatnonzero(dark[top:bottom].any(axis=0))
            out.append((int(columns[0]), top, int(columns[-1]) + 1, bottom))
    return out


def components(hit: np.ndarray) -> np.ndarray:
    """Labels of eight-connected components (0: background), numbered by their first pixel."""
    label = np.where(hit, np.arange(1, hit.size + 1).reshape(hit.shape), 0)
    while True:
        padded = np.pad(label, 1)
        best = np.where(hit, hit.size + 1, 0)
        for dy in range(3):
            for dx in range(3):
                near = padded[dy : dy + hit.shape[0], dx : dx + hit.shape[1]]
                best = np.where(hit & (near > 0), np.minimum(best, near), best)
        # a label names a pixel; that pixel's own label is as low or lower, so long paths close in few rounds
        best = np.append(0, best.ravel())[best]
        if (best == label).all():
            return np.unique(label, return_inverse=True)[1].reshape(hit.shape) + (0 if (label == 0).any() else 1)
        label = best


def masked(page: np.ndarray, boxes: list, value: int = 0) -> np.ndarray:
    out = page.copy()
    for left, top, right, bottom in boxes:
        out[max(top, 0) : bottom, max(left, 0) : right] = value
    return out


def skew_angle(page: np.ndarray, most: int = 12) -> int:
    """Degrees at which rows of ink are sharpest."""
    y, x = np.nonzero(ink(page))
    if not len(y):
        return 0
    sharp = [(np.bincount((y * np.cos(a) - x * np.sin(a) - (y * np.cos(a) - x * np.sin(a)).min()).astype(int)).astype(float) ** 2).sum() for a in np.deg2rad(np.arange(-most, most + 1))]
    return int(np.argmax(sharp)) - most


def page_lines(df: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, line_id, order, left, top, right, bottom) of pages (key, width, height, pixels)."""
    schema = T.StructType([df.schema[key], T.StructField("line_id", T.StringType())] + [T.StructField(n, T.IntegerType()) for n in ("order", "left", "top", "right", "bottom")])

    def run(batches):
        for batch in batches:
            rows = []
            for name, width, height, pixels in zip(batch[key], batch["width"], batch["height"], batch["pixels"], strict=True):
                page = np.asarray(pixels, dtype=np.int64).reshape(int(height), int(width))
                rows += [(name, f"{name}-L{k:04d}", k, *box) for k, box in enumerate(text_lines(page), 1)]
            yield pd.DataFrame(rows, columns=schema.names)

    return df.select(key, "width", "height", "pixels").mapInPandas(run, schema)
