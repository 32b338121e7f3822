"""RGB columns to Lab, as in ``lodemine.kernels.color``, for pixels that are rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodemine.kernels.color import DARK, LIMIT, OFFSET, SLOPE, TO_XYZ, WHITE


def lab(r: Column, g: Column, b: Column) -> Column:
    """struct<L,a,b> of values from 0 to 1."""
    t = [(r * float(m[0]) + g * float(m[1]) + b * float(m[2])) / float(w) for m, w in zip(TO_XYZ, WHITE)]
    f = [F.when(v > LIMIT, F.cbrt(v)).otherwise(v * SLOPE + OFFSET) for v in t]
    light = F.when(t[1] > LIMIT, f[1] * 116 - 16).otherwise(t[1] * DARK)
    return F.struct(light.alias("L"), ((f[0] - f[1]) * 500).alias("a"), ((f[1] - f[2]) * 200).alias("b"))
