"""Patches drawn by gradient weight."""

from __future__ import annotations

import numpy as np

from lodemine.config import PyramidParams
from lodemine.kernels.gradients import sampling_weight
from lodemine.kernels.pyramid import build, windows


def gaussian(size: int, sigma: float) -> np.ndarray:
    """A normalised square kernel; entries below eps x its maximum are 0."""
    r = (size - 1) / 2
    g = np.exp(-((np.arange(size) - r) ** 2) / (2 * sigma * sigma))
    k = np.outer(g, g)
    k[k < np.finfo(float).eps * k.max()] = 0
    return k / k.sum()


def blur(image: np.ndarray, size: int, sigma: float) -> np.ndarray:
    """Beyond the border there is nothing. A kernel of even size reaches one pixel further ahead."""
    r = (size - 1) / 2
    g = np.exp(-((np.arange(size) - r) ** 2) / (2 * sigma * sigma))
    g /= g.sum()
    out = image
    for axis in (0, 1):
        wide = np.pad(out, [((size - 1) // 2, size // 2) if a == axis else (0, 0) for a in (0, 1)])
        out = np.apply_along_axis(lambda v: np.convolve(v, g, "valid"), axis, wide)
    return out


def distribution(weight: np.ndarray, patch: float) -> np.ndarray:
    """Of a pixel: the gradient weight blurred with a deviation of a third of the patch, normalised;
    uniform if there is no gradient."""
    p = blur(weight, max(1, round(patch)), patch / 3)
    return p / p.sum() if p.sum() > 0 else np.full(weight.shape, 1 / weight.size)


def quick_distribution(weight: np.ndarray, patch: float) -> np.ndarray:
    """Of a pixel: its own gradient weight over the sum of the blurred ones; uniform if there is none."""
    total = blur(weight, max(1, round(patch)), patch / 3).sum()
    return weight / total if total > 0 else np.full(weight.shape, 1 / weight.size)


def draw(p: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n indices (column-major) by inverse distribution function."""
    c = np.cumsum(p.ravel(order="F"))
    return np.minimum(np.searchsorted(c, rng.random(n) * c[-1], side="right"), p.size - 1)


def clean_coverage(boxes: np.ndarray, weight: np.ndarray, share: float = 0.6) -> np.ndarray:
    """Indices, ascending, of the boxes that are kept: by falling weight, a box goes if more than
    share of its area lies under the union of those kept."""
    if not len(boxes):
        return np.zeros(0, int)
    mask = np.zeros((boxes[:, 3].max() + 1, boxes[:, 2].max() + 1), bool)
    kept = []
    for i in np.lexsort((np.arange(len(boxes)), -weight)):
        x1, y1, x2, y2 = boxes[i]
        if mask[y1 : y2 + 1, x1 : x2 + 1].mean() <= share:
            mask[y1 : y2 + 1, x1 : x2 + 1] = True
            kept.append(int(i))
    return np.sort(np.asarray(kept, int))


def sample_patches(image: np.ndarray, params: PyramidParams, seed: int, most: int = 25, share: float = 0.6, level_factor: float = 2.0, quick: bool = False) -> list[dict]:
    """Patches of every half octave's level: level, cy, cx, box, probability, feat. quick: draw by the
    gradient weight as it is, not by the blurred one."""
    rng = np.random.default_rng(seed)
    rows, cols = image.shape[:2]
    weight = sampling_weight(image)
    chosen = list(range(0, 99, params.intervals // 2))
    pyramid = build(image, params, chosen)
    n = params.patch_cells
    found: list[dict] = []
    for k, level in zip(chosen, pyramid.levels):
        unit = params.cell * level.scale / pyramid.canonical_scale
        side = params.patch_size * level.scale / pyramid.canonical_scale
        draws = int(rows / (side / level_factor) * (cols / (side / level_factor)) * 2)
        p = (quick_distribution if quick else distribution)(weight, side)
        at = draw(p, draws, rng)
        y, x = at % rows, at // rows
        cy, cx = np.ceil((y + 1) / unit).astype(int) - 1 - n // 2, np.ceil((x + 1) / unit).astype(int) - 1 - n // 2
        ok = (cy >= 0) & (cx >= 0) & (cy <= level.cells.shape[0] - n) & (cx <= level.cells.shape[1] - n)
        if not ok.any():
            continue
        cell, first = np.unique(np.stack([cx[ok], cy[ok]], 1), axis=0, return_index=True)
        prob = p.ravel(order="F")[at[ok]][first]
        x1, y1 = np.floor(cell[:, 0] * unit).astype(int), np.floor(cell[:, 1] * unit).astype(int)
        last = int(np.rint((n + 2) * unit)) - 1
        boxes = np.stack([x1, y1, np.minimum(x1 + last, cols - 1), np.minimum(y1 + last, rows - 1)], 1)
        f, g, wy, wx = windows(level, n)
        row_of = {(a, b): i for i, (a, b) in enumerate(zip(wx.tolist(), wy.tolist()))}
        for i in clean_coverage(boxes, prob, share):
            found.append({"level": k, "cy": int(cell[i, 1]), "cx": int(cell[i, 0]), "box": boxes[i].tolist(), "probability": float(prob[i]), "gradsum": float(g[row_of[tuple(cell[i])]]), "feat": f[row_of[tuple(cell[i])]]})
    order = rng.permutation(len(found))[:most] if most else range(len(found))
    return [found[i] for i in order]
