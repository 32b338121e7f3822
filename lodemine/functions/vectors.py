"""Array columns as vectors, with higher-order functions; elements count as double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def standardise(v: Column) -> Column:
    """(v - mean) / (population deviation * length + 1e-15)."""
    n = F.size(v)
    shifted = F.transform(F.array(total(v) / n), lambda m: F.transform(v, lambda x: x - m))[0]
    return F.transform(F.array(F.struct(shifted.alias("c"), n.alias("n"))), lambda s: F.transform(s["c"], lambda x: x / (F.sqrt(dot(s["c"], s["c"]) / s["n"]) * s["n"] + F.lit(1e-15))))[0]


def decision(v: Column, weights: Column, rho: Column, first_label: Column | int = 1) -> Column:
    return (dot(v, weights) - rho) * first_label


def predicted(score: Column) -> Column:
    """1 or -1; 0 counts as -1."""
    return F.when(score > 0, 1).otherwise(-1)


def dense(sparse: Column, width: int) -> Column:
    """map<int,double> with 1-based keys to an array; keys without a value are 0."""
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.coalesce(F.element_at(sparse, i), F.lit(0.0)))
