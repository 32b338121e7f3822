"""Separable resizing with antialiasing, as published for bicubic and triangle kernels.

An output pixel is a weighted sum of the input pixels under a kernel that is widened when the image
shrinks; pixels beyond the border repeat the border pixel.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(1 - np.abs(x), 0)


def cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(x)
    near = (a + 2) * x**3 - (a + 3) * x**2 + 1
    far = a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a
    return np.where(x <= 1, near, np.where(x < 2, far, 0.0))


KERNELS = {"bicubic": (cubic, 4.0), "bilinear": (triangle, 2.0)}


@lru_cache(maxsize=256)
def weights(n_in: int, n_out: int, scale: float, method: str) -> np.ndarray:
    """A matrix n_out x n_in of which each row sums to 1."""
    kernel, width = KERNELS[method]
    shrink = min(scale, 1.0)
    centre = (np.arange(n_out) + 0.5) / scale - 0.5
    reach = width / shrink / 2
    first = np.floor(centre - reach).astype(int)
    taps = first[:, None] + np.arange(math.ceil(2 * reach) + 2)
    w = kernel((centre[:, None] - taps) * shrink)
    w /= w.sum(1, keepdims=True)
    out = np.zeros((n_out, n_in))
    np.add.at(out, (np.arange(n_out)[:, None], np.clip(taps, 0, n_in - 1)), w)
    out.setflags(write=False)
    return out


def resize(image: np.ndarray, scale: float | None = None, shape: tuple[int, int] | None = None, method: str = "bicubic") -> np.ndarray:
    """By a scale (sizes rounded up) or to rows and columns. Bytes come back as bytes."""
    rows, cols = image.shape[:2]
    if shape is None:
        shape = (math.ceil(rows * scale), math.ceil(cols * scale))
        scales = (scale, scale)
    else:
        scales = (shape[0] / rows, shape[1] / cols)
    x = image.astype(np.float64)
    for axis in np.argsort(scales, kind="stable"):  # the axis that shrinks more goes first
        w = weights(image.shape[axis], shape[axis], float(scales[axis]), method)
        x = np.moveaxis(np.tensordot(w, x, (1, axis)), 0, axis)
    return to_bytes(x / 255) if image.dtype == np.uint8 else x


def to_bytes(image: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(image, 0, 1) * 255).astype(np.uint8)


def canonical(image: np.ndarray, size: int, fast: bool = True) -> tuple[np.ndarray, float]:
    """Scaled so that the rows (fast) or the smaller side have the size, and the scale."""
    rows, cols = image.shape[:2]
    scale = size / (rows if fast else min(rows, cols))
    return resize(image, scale, method="bilinear" if fast else "bicubic"), scale
