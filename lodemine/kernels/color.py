"""RGB to Lab with the D65 white point, without gamma."""

from __future__ import annotations

import numpy as np

# The RGB to XYZ matrix, the white point, and the constants of the Lab formula.
TO_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
WHITE = np.array([0.950456, 1.0, 1.088754])
LIMIT, SLOPE, OFFSET, DARK = 0.008856, 7.787, 16 / 116, 903.3


def rgb_to_lab(image: np.ndarray) -> np.ndarray:
    """Values beyond 1 on average are taken as 0 to 255."""
    rgb = image / 255 if image.mean() > 1 else image
    t = rgb @ TO_XYZ.T / WHITE
    f = np.where(t > LIMIT, np.cbrt(np.maximum(t, LIMIT)), SLOPE * t + OFFSET)
    y = t[..., 1]
    light = np.where(y > LIMIT, 116 * f[..., 1] - 16, DARK * y)
    return np.stack([light, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)
