"""Boxes are pixel-inclusive: their width is x2 - x1 + 1. A box is a struct<x1,y1,x2,y2>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    return F.struct(F.col(x1).cast("int").alias("x1"), F.col(y1).cast("int").alias("y1"), F.col(x2).cast("int").alias("x2"), F.col(y2).cast("int").alias("y2"))


def area(b: Column) -> Column:
    return ((b["x2"] - b["x1"] + 1) * (b["y2"] - b["y1"] + 1)).cast("long")


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]) + 1
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]) + 1
    return F.when((w > 0) & (h > 0), (w * h).cast("long")).otherwise(F.lit(0).cast("long"))


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    return both / (area(a) + area(b) - both)


def overlap_of_first(a: Column, b: Column) -> Column:
    """The share of a that b covers."""
    return intersection(a, b) / area(a)


def covered_area(b: Column, boxes: Column) -> Column:
    """The pixels of b under the union of an array of boxes: b is cut at the sides of those that meet
    it, and each piece counts that any of them covers."""
    inside = F.transform(F.filter(boxes, lambda k: intersection(k, b) > 0), lambda k: F.struct(F.greatest(k["x1"], b["x1"]).alias("x1"), F.greatest(k["y1"], b["y1"]).alias("y1"), (F.least(k["x2"], b["x2"]) + 1).alias("x2"), (F.least(k["y2"], b["y2"]) + 1).alias("y2")))
    cuts = lambda c, lo, hi: F.array_sort(F.array_distinct(F.concat(F.transform(c, lambda k: k[lo]), F.transform(c, lambda k: k[hi]))))
    pieces = lambda of: F.sequence(F.lit(0), F.size(of) - 2)
    none = F.lit(0).cast("long")

    def area_of(z: Column) -> Column:
        c, xs, ys = z["c"], z["xs"], z["ys"]
        covers = lambda i, j: F.exists(c, lambda k: (k["x1"] <= xs[i]) & (k["x2"] > xs[i]) & (k["y1"] <= ys[j]) & (k["y2"] > ys[j]))
        column = lambda i: F.aggregate(pieces(ys), none, lambda acc, j: acc + F.when(covers(i, j), ys[j + 1] - ys[j]).otherwise(0))
        return F.when(F.size(c) == 0, none).otherwise(F.aggregate(pieces(xs), none, lambda acc, i: acc + (xs[i + 1] - xs[i]) * column(i)))

    named = F.transform(F.array(inside), lambda c: F.struct(c.alias("c"), cuts(c, "x1", "x2").alias("xs"), cuts(c, "y1", "y2").alias("ys")))
    return F.transform(named, area_of)[0]


def is_square(b: Column) -> Column:
    return (b["x2"] - b["x1"]) == (b["y2"] - b["y1"])


def clip(b: Column, ncols: Column, nrows: Column, inclusive_end: bool = False) -> Column:
    """Into [0, n - 1] on each axis; inclusive_end: into [0, n], as the neighbour path does."""
    last = 0 if inclusive_end else 1
    into = lambda v, n: F.greatest(F.least(v, n - last), F.lit(0)).cast("int")
    return F.struct(into(b["x1"], ncols).alias("x1"), into(b["y1"], nrows).alias("y1"), into(b["x2"], ncols).alias("x2"), into(b["y2"], nrows).alias("y2"))


def cell_box(level: Column, cy: Column, cx: Column, scale: Column, canonical: Column, cell: int = 8, patch_cells: int = 8) -> Column:
    """The pixels of a pyramid cell's patch: offset floor(cell * size * scale / canonical), side
    round-half-even((cells + 2) * size * scale / canonical) - 1."""
    unit = F.lit(float(cell)) * scale / canonical
    side = F.bround(F.lit(float(patch_cells + 2)) * unit).cast("int") - 1
    x, y = F.floor(cx * unit).cast("int"), F.floor(cy * unit).cast("int")
    return F.struct(x.alias("x1"), y.alias("y1"), (x + side).alias("x2"), (y + side).alias("y2"))


def pyramid_levels(nrows: Column, ncols: Column, intervals: int = 8, patch: int = 80) -> Column:
    fit = lambda n: F.floor(F.lit(float(intervals)) * F.log2(n / F.lit(float(patch))))
    return (F.least(fit(nrows), fit(ncols)) + 1).cast("int")


def level_scale(level: Column, intervals: int = 8) -> Column:
    return F.pow(F.lit(2.0), level / F.lit(float(intervals)))


def derived_size(n: Column, scale: Column) -> Column:
    return F.ceil(n * scale).cast("long")


def canonical_scale(nrows: Column, ncols: Column, size: int, smaller_side: bool = True) -> Column:
    return F.lit(float(size)) / (F.least(nrows, ncols) if smaller_side else nrows)


def subscripts(index: Column, rows: int) -> Column:
    """Row and column of a 0-based column-major index."""
    return F.struct(F.pmod(index, F.lit(rows)).alias("row"), F.floor(index / rows).alias("col"))


def linear_index(row: Column, col: Column, rows: int) -> Column:
    return col * rows + row
