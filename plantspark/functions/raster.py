"""Pixel kernels in numpy, and Arrow steps that apply them to (path, height, width, pixels) rows.

A row is one grey image of height * width bytes. Rows with null pixels give null results. Work and
memory are per image; tiles keep images small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def otsu(grey: np.ndarray) -> int:
    """The threshold of greatest variance between both sides."""
    n = np.bincount(grey.ravel(), minlength=256).astype(float)
    below, total = np.cumsum(n), n.sum()
    mass = np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mass[-1] * below / total - mass) ** 2 / (below * (total - below))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def box_mean(grey: np.ndarray, size: int) -> np.ndarray:
    """Mean over a square window, edges repeated."""
    r = size // 2
    s = np.pad(np.pad(grey.astype(float), r, mode="edge").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]) / size**2


def binarise(grey: np.ndarray, size: int = 31, offset: float = 10) -> np.ndarray:
    """Ink as true: by Otsu if more than 60 % of the pixels are white, else below the local mean."""
    if (grey > 200).mean() > 0.6:
        return grey <= otsu(grey)
    return grey < box_mean(grey, size) - offset


def _shifted(ink: np.ndarray, width: int, height: int, pick: Callable) -> np.ndarray:
    x, y = width // 2, height // 2
    p = np.pad(ink, ((y, height - 1 - y), (x, width - 1 - x)), constant_values=pick is np.logical_and)
    h, w = ink.shape
    out = p[:h, :w].copy()
    for dy in range(height):
        for dx in range(width):
            out = pick(out, p[dy : dy + h, dx : dx + w])
    return out


def opened(ink: np.ndarray, width: int, height: int) -> np.ndarray:
    """Erosion and then dilation by a rectangle."""
    return _shifted(_shifted(ink, width, height, np.logical_and)[::-1, ::-1], width, height, np.logical_or)[::-1, ::-1]


def closed(ink: np.ndarray, width: int, height: int) -> np.ndarray:
    """Dilation and then erosion by a rectangle."""
    return _shifted(_shifted(ink, width, height, np.logical_or)[::-1, ::-1], width, height, np.logical_and)[::-1, ::-1]


def runs(ink: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(row, start, end) of horizontal runs of at least ``least`` pixels; end excluded."""
    edge = np.diff(np.pad(ink.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (y, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    keep = b - a >= least
    return list(zip(y[keep].tolist(), a[keep].tolist(), b[keep].tolist()))


def components(ink: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, area) of 8-connected components, from runs that touch in neighbouring rows."""
    r = runs(ink, 1)
    root = list(range(len(r)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    by_row: dict[int, list[int]] = {}
    for i, (y, a, b) in enumerate(r):
        for j in by_row.get(y - 1, ()):
            if r[j][1] <= b and a <= r[j][2]:
                x, z = sorted((find(i), find(j)))
                root[z] = x
        by_row.setdefault(y, []).append(i)
    out: dict[int, list[int]] = {}
    for i, (y, a, b) in enumerate(r):
        o = out.setdefault(find(i), [a, y, b, y + 1, 0])
        o[:] = [min(o[0], a), min(o[1], y), max(o[2], b), max(o[3], y + 1), o[4] + b - a]
    return sorted((x1, y1, x2 - x1, y2 - y1, n) for x1, y1, x2, y2, n in out.values())


def _around(ink: np.ndarray) -> np.ndarray:
    """The eight neighbours of each pixel, clockwise from above."""
    p = np.pad(ink, 1).astype(np.uint8)
    h, w = ink.shape
    return np.stack([p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))])


def skeleton(ink: np.ndarray) -> np.ndarray:
    """Thinning to lines of one pixel by the two-step rule of Zhang and Suen."""
    ink = ink.copy()
    while True:
        before = ink.sum()
        for first in (True, False):
            n = _around(ink)
            count = n.sum(0)
            turns = ((n == 0) & (np.roll(n, -1, axis=0) == 1)).sum(0)
            up, right, down, left = n[0], n[2], n[4], n[6]
            a, b = (up * right * down, right * down * left) if first else (up * right * left, up * down * left)
            ink &= ~((count >= 2) & (count <= 6) & (turns == 1) & (a == 0) & (b == 0))
        if ink.sum() == before:
            return ink


def line_points(thin: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(x, y) of branches (three or more neighbours) and of ends (one)."""
    n = _around(thin).sum(0)
    at = lambda m: [(int(x), int(y)) for y, x in zip(*np.nonzero(m & thin))]
    return at(n >= 3), at(n == 1)


def masked(grey: np.ndarray, boxes: list[tuple[int, int, int, int]], pad: int) -> np.ndarray:
    """White where the padded boxes are."""
    out = grey.copy()
    for x1, y1, x2, y2 in boxes:
        out[max(0, y1 - pad) : y2 + pad, max(0, x1 - pad) : x2 + pad] = 255
    return out


def straight_lines(grey: np.ndarray, share: int = 40) -> list[tuple[int, int, int, int]]:
    """(x1, y1, x2, y2) of long horizontal and vertical strokes: openings by a share of the size, then boxes."""
    ink = binarise(grey)
    h, w = ink.shape
    found = []
    for m in (opened(ink, max(2, w // share), 1), opened(ink, 1, max(2, h // share))):
        for x, y, bw, bh, _ in components(m):
            found.append((x, y + bh // 2, x + bw - 1, y + bh // 2) if bw >= bh else (x + bw // 2, y, x + bw // 2, y + bh - 1))
    return sorted(found)


def each_image(images: DataFrame, kernel: Callable[[np.ndarray], list[tuple]], columns: str) -> DataFrame:
    """One row per tuple that the kernel gives for an image: path and ``columns`` (all int)."""
    names = [c.split()[0] for c in columns.split(",")]

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, h, w, data in zip(*(batch.column(c).to_pylist() for c in ("path", "height", "width", "pixels"))):
                rows = kernel(np.frombuffer(data, np.uint8).reshape(h, w)) if data is not None else []
                values = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array(v, pa.int32()) for v in values)], names=["path", *names])

    return images.select("path", "height", "width", "pixels").mapInArrow(applied, f"path string, {columns}")


def line_segments(images: DataFrame) -> DataFrame:
    return each_image(images, straight_lines, "x1 int, y1 int, x2 int, y2 int")


def symbol_candidates(images: DataFrame, least_area: int = 30, least_side: int = 6) -> DataFrame:
    """Components of ink that could be symbols: large enough, and no more than eight times as long as wide."""

    def kernel(grey: np.ndarray) -> list[tuple]:
        return [c for c in components(binarise(grey)) if c[4] >= least_area and min(c[2:4]) >= least_side and max(c[2:4]) <= 8 * min(c[2:4])]

    return each_image(images, kernel, "x int, y int, w int, h int, area int")


def branch_points(images: DataFrame) -> DataFrame:
    return each_image(images, lambda g: line_points(skeleton(binarise(g)))[0], "x int, y int")
