"""Updates in place and draining, as new tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from weirflow.operators.pipe import Item, Pipe, true
from weirflow.plans.order import ORD, dense_index
from weirflow.plans.shared import written

#: Positions up to which a drained range is found by a limit instead of an index of all rows.
FEW = 100_000


def update_where(pipe: Pipe, predicate: Callable[[Item], Column], update: Callable[[Item], dict[str, Column]]) -> Pipe:
    """All elements, those that meet the predicate with the columns that ``update`` returns."""
    hit, new = true(predicate(pipe.item)), update(pipe.item)
    unknown = set(new) - set(pipe.items)
    if unknown:
        raise KeyError(f"not among the items: {sorted(unknown)}")
    return replace(pipe, df=pipe.df.select(ORD, *(F.when(hit, new[n]).otherwise(F.col(n)).alias(n) if n in new else F.col(n) for n in pipe.items)))


def par_drain(pipe: Pipe, begin: int, end: int) -> tuple[Pipe, Pipe]:
    """The elements at positions ``begin .. end - 1``, and the rest, both in order."""
    if not 0 <= begin <= end:
        raise ValueError("0 <= begin <= end must hold")
    if end <= FEW:  # so many rows fit into a task: the least of each partition are enough
        place = F.row_number().over(Window.orderBy(ORD)) - 1
        first = pipe.df.orderBy(ORD).limit(end).withColumn("__index", place)
        taken = written(first.where(F.col("__index") >= begin).drop("__index"), "drained")
        key = F.struct(F.col(ORD).alias("o"))
        bounds = taken.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
        inside = (key >= bounds.select("lo").scalar()) & (key <= bounds.select("hi").scalar())
        return replace(pipe, df=taken), replace(pipe, df=pipe.df.where(~F.coalesce(inside, F.lit(False))))
    indexed = dense_index(pipe.df, "__index")
    inside = (F.col("__index") >= begin) & (F.col("__index") < end)
    return replace(pipe, df=indexed.where(inside).drop("__index")), replace(pipe, df=indexed.where(~inside).drop("__index"))
