"""Small numbers: rounded division, sizes, rotation of a list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div_up(a: Column, b: Column | int) -> Column:
    return F.ceil(a / b).cast("long")


def div_to_nearest(a: Column, b: Column | int) -> Column:
    """a / b to the nearest whole number, halves up."""
    return F.floor(a / b + 0.5).cast("long")


def mebibytes(size: Column) -> Column:
    return size / (1 << 20)


def rotated(items: Column, by: Column | int) -> Column:
    """An array that starts at item ``by`` (from 0, modulo its size) and goes on from its end to its start."""
    n = F.size(items)
    at = F.pmod(F.lit(by) if isinstance(by, int) else by, F.greatest(n, F.lit(1)))
    return F.when(n > 0, F.concat(F.slice(items, at + 1, n), F.slice(items, F.lit(1), at))).otherwise(items)
