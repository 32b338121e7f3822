"""Feature pyramids and their sliding windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from lodemine.config import PyramidParams
from lodemine.kernels.color import rgb_to_lab
from lodemine.kernels.gradients import energy, histogram
from lodemine.kernels.resize import canonical, resize


@dataclass
class Level:
    scale: float
    cells: np.ndarray
    gradient: np.ndarray


@dataclass
class Pyramid:
    levels: list[Level]
    canonical_scale: float


def level_count(rows: int, cols: int, intervals: int, patch: int) -> int:
    return int(min(np.floor(intervals * np.log2(n / patch)) for n in (rows, cols))) + 1


def build(image: np.ndarray, params: PyramidParams, levels: list[int] | None = None) -> Pyramid:
    """image: RGB from 0 to 1. Level k is the image at canonical scale / 2^(k / intervals), cut to
    whole cells; an image that is smaller than a patch has no levels."""
    whole, scale = canonical(image, params.canonical_size)
    lab = rgb_to_lab(image)[..., 1:] * params.color_weight if params.use_color else None
    out = []
    for k in range(level_count(*whole.shape[:2], params.intervals, params.patch_size)):
        if levels is not None and k not in levels:
            continue
        s = 2 ** (k / params.intervals)
        x = resize(image, scale / s, method="bilinear")
        x = np.round(x[: x.shape[0] // params.cell * params.cell, : x.shape[1] // params.cell * params.cell], 8)
        cells = histogram(x, params.cell)
        if params.use_color:
            cells = np.concatenate([cells, resize(lab, shape=cells.shape[:2], method="bilinear")], -1)
        out.append((k, Level(s, cells, resize(energy(x), shape=cells.shape[:2], method="bilinear"))))
    return Pyramid([lv for _, lv in out], scale)


def windows(level: Level, size: int, min_gradient: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features (column-major per channel), mean gradient, and row and column of each window, column
    by column; windows under min_gradient are left out before their features are made."""
    rows, cols = (n - size + 1 for n in level.cells.shape[:2])
    if rows <= 0 or cols <= 0:
        return np.zeros((0, size * size * level.cells.shape[2])), np.zeros(0), np.zeros(0, int), np.zeros(0, int)
    mean = sliding_window_view(level.gradient, (size, size)).mean((2, 3))
    x, y = (a.ravel() for a in np.meshgrid(np.arange(cols), np.arange(rows), indexing="ij"))
    g = mean[y, x]
    if min_gradient is not None:
        keep = g >= min_gradient
        x, y, g = x[keep], y[keep], g[keep]
    view = sliding_window_view(level.cells, (size, size), axis=(0, 1))  # row, col, channel, dy, dx
    f = view[y, x].transpose(0, 1, 3, 2).reshape(len(x), -1)  # channel, dx, dy
    return f, g, y, x


def scores(level: Level, size: int, weights: np.ndarray, min_gradient: float | None = None, block: int = 128) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """weights: rows as windows() orders features. For blocks of them: the first row's number, and the
    products with each window, and the windows' rows and columns, as ``windows() @ weights.T``.

    No window is made: at each place of a window all cells are multiplied at once, as each cell is in
    up to size x size windows, and the products are added up, shifted to the windows' corners."""
    rows, cols = (n - size + 1 for n in level.cells.shape[:2])
    if rows <= 0 or cols <= 0:
        return
    x, y = (a.ravel() for a in np.meshgrid(np.arange(cols), np.arange(rows), indexing="ij"))
    if min_gradient is not None:
        keep = sliding_window_view(level.gradient, (size, size)).mean((2, 3))[y, x] >= min_gradient
        x, y = x[keep], y[keep]
    height, width, channels = level.cells.shape
    cells = np.ascontiguousarray(level.cells).reshape(-1, channels)
    for at in range(0, len(weights), block):
        w = weights[at : at + block].reshape(-1, channels, size, size)  # detector, channel, dx, dy
        total = np.zeros((rows, cols, len(w)))
        for dx in range(size):
            for dy in range(size):
                total += (cells @ w[:, :, dx, dy].T).reshape(height, width, -1)[dy : dy + rows, dx : dx + cols]
        yield at, total[y, x], y, x


def crop(image: np.ndarray, x1: int, y1: int, x2: int, y2: int, longer_side: int | None = 80) -> np.ndarray:
    """The pixels of an inclusive box, the longer side resized."""
    part = image[y1 : y2 + 1, x1 : x2 + 1]
    return resize(part, longer_side / max(part.shape[:2])) if longer_side else part
