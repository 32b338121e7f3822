"""Oriented gradient histograms with 31 channels per cell (Felzenszwalb et al., 2010), and
gradient energy."""

from __future__ import annotations

import numpy as np

ORIENTATIONS = 9
EPS = 1e-4
CLIP, TEXTURE = 0.2, 0.2357  # fixed values of the descriptor


def histogram(image: np.ndarray, cell: int) -> np.ndarray:
    """rows - 2 by cols - 2 cells of 18 signed, 9 unsigned and 4 texture channels. Half a cell at the
    border counts as one; its pixels beyond the image repeat the last gradient."""
    rows, cols = (int(n / cell + 0.5) for n in image.shape[:2])
    if rows < 3 or cols < 3:
        return np.zeros((max(rows - 2, 0), max(cols - 2, 0), 31))
    hist = _votes(image.astype(np.float64), rows, cols, cell)
    energy = ((hist[..., :9] + hist[..., 9:]) ** 2).sum(-1)
    block = energy[:-1, :-1] + energy[1:, :-1] + energy[:-1, 1:] + energy[1:, 1:]
    inner = hist[1:-1, 1:-1]
    signed, unsigned, texture = 0.0, 0.0, []
    for dy, dx in ((1, 1), (0, 1), (1, 0), (0, 0)):  # the four blocks that hold the cell
        norm = 1 / np.sqrt(block[dy : dy + rows - 2, dx : dx + cols - 2] + EPS)[..., None]
        part = np.minimum(inner * norm, CLIP)
        signed = signed + 0.5 * part
        unsigned = unsigned + 0.5 * np.minimum((inner[..., :9] + inner[..., 9:]) * norm, CLIP)
        texture.append(TEXTURE * part.sum(-1))
    return np.concatenate([signed, unsigned, np.stack(texture, -1)], -1)


def _votes(image: np.ndarray, rows: int, cols: int, cell: int) -> np.ndarray:
    """Each pixel's strongest channel votes for its orientation in the four nearest cells."""
    h, w = rows * cell, cols * cell
    near = lambda n, size: np.minimum(np.arange(1, n - 1), size - 2) - 1
    at = np.ix_(near(h, image.shape[0]), near(w, image.shape[1]))
    dy, dx = (image[2:, 1:-1] - image[:-2, 1:-1])[at], (image[1:-1, 2:] - image[1:-1, :-2])[at]
    strength = dx * dx + dy * dy
    best = strength.argmax(-1)[..., None]
    dy, dx, v = (np.take_along_axis(a, best, -1)[..., 0] for a in (dy, dx, strength))
    del strength, best
    angle = np.arange(ORIENTATIONS) * np.pi / ORIENTATIONS
    direction, most = np.zeros(v.shape, int), np.full(v.shape, -np.inf)
    for sign in (1, -1):  # one orientation after another: all at once would be most of a worker's memory
        for k in range(ORIENTATIONS):
            along = sign * (dx * np.cos(angle[k]) + dy * np.sin(angle[k]))
            more = along > most
            direction[more] = k if sign > 0 else k + ORIENTATIONS
            most[more] = along[more]
    direction[~(v > 0)] = 0
    del dy, dx, along, most, more
    yy, xx = np.ogrid[1 : h - 1, 1 : w - 1]
    cy, cx = (yy + 0.5) / cell - 0.5, (xx + 0.5) / cell - 0.5
    iy, ix = np.floor(cy).astype(int), np.floor(cx).astype(int)
    fy, fx, v = cy - iy, cx - ix, np.sqrt(v)
    out = np.zeros((rows, cols, 2 * ORIENTATIONS))
    for oy, wy in ((0, 1 - fy), (1, fy)):
        for ox, wx in ((0, 1 - fx), (1, fx)):
            ok = (iy + oy >= 0) & (iy + oy < rows) & (ix + ox >= 0) & (ix + ox < cols)
            row, column = (np.broadcast_to(i, ok.shape)[ok] for i in (iy + oy, ix + ox))
            np.add.at(out, (row, column, direction[ok]), (wy * wx * v)[ok])
    return out


def energy(image: np.ndarray, scale: float = 255.0) -> np.ndarray:
    """Mean over channels of the squared gradient."""
    gy, gx = np.gradient(image * scale, axis=(0, 1))
    return (gx**2).mean(-1) + (gy**2).mean(-1)


def sampling_weight(image: np.ndarray) -> np.ndarray:
    """(sum |gx| + sum |gy|) squared, over channels."""
    gy, gx = np.gradient(image, axis=(0, 1))
    return (np.abs(gx).sum(-1) + np.abs(gy).sum(-1)) ** 2
