"""Reductions known by name: built-in aggregates with partial sums on each side of the exchange."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: name -> aggregate; NULL for no items.
MONOIDS: dict[str, Callable[[Column], Column]] = {
    "add": F.sum,
    "multiply": F.product,
    "min": F.min,
    "max": F.max,
    "and": F.bool_and,
    "or": F.bool_or,
    "bit_and": F.bit_and,
    "bit_or": F.bit_or,
    "bit_xor": F.bit_xor,
}


def monoid(name: str, item: Column) -> Column:
    if name not in MONOIDS:
        raise ValueError(f"unknown reduction {name!r}; known are {sorted(MONOIDS)}")
    return MONOIDS[name](item)
