"""Recursive traversal: a frontier that grows while it is consumed, one level a round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from weirflow.operators.pipe import Pipe
from weirflow.plans.order import ORD
from weirflow.plans.shared import new_path


class TooDeep(RuntimeError):
    """The frontier was not empty after the allowed number of levels; cyclic inputs end here."""


def par_rec(roots: DataFrame, extend: Callable[[DataFrame], DataFrame], most_levels: int = 1000) -> Pipe:
    """All elements reached from ``roots`` by ``extend``, breadth first, roots at ``depth`` 0.

    ``extend`` maps the elements of a level to those of the next, with the columns of ``roots``;
    an element reached on several ways is there as often. Every level is one written table, so
    no round recomputes those before. Within a level the order is that of the columns.
    """
    spark, columns = roots.sparkSession, roots.columns
    path = new_path(spark, "levels")
    level, depth = roots, 0
    while True:
        level.select(*columns).write.parquet(f"{path}/depth={depth}")
        level = spark.read.schema(roots.schema).parquet(f"{path}/depth={depth}")
        if level.isEmpty():
            break
        if depth == most_levels:
            raise TooDeep(f"elements remain after {most_levels} levels")
        level, depth = extend(level).select(*columns), depth + 1
    found = spark.read.schema(StructType([*roots.select(*columns).schema.fields, StructField("depth", IntegerType())])).option("basePath", path).parquet(path)
    order = F.struct("depth", *columns)
    return Pipe(found.select(order.alias(ORD), *columns, "depth"), (*columns, "depth"))


class OtherLength(ValueError):
    """A traversal did not have the number of elements that was promised."""


def par_rec_exact(roots: DataFrame, extend: Callable[[DataFrame], DataFrame], length: int, most_levels: int = 1000) -> Pipe:
    """``par_rec`` where the number of elements, roots included, is known beforehand; another number is an error."""
    pipe = par_rec(roots, extend, most_levels)
    found = pipe.df.count()
    if found != length:
        raise OtherLength(f"{found} elements, not {length}")
    return pipe


def par_rec_edges(roots: DataFrame, edges: DataFrame, node: str = "node", parent: str = "parent", child: str = "child", prune: Callable | None = None, most_levels: int = 1000) -> Pipe:
    """``par_rec`` over a table of edges. ``prune``: a predicate on (parent, child) that children must meet."""

    def extend(level: DataFrame) -> DataFrame:
        met = level.select(F.col(node).alias(parent)).join(edges, parent)
        return (met.where(prune(F.col(parent), F.col(child))) if prune else met).select(F.col(child).alias(node))

    return par_rec(roots.select(node), extend, most_levels)


def linearize(pipe: Pipe) -> Pipe:
    """The same elements as a flat, written table; what follows is spread evenly over tasks."""
    spark = pipe.df.sparkSession
    path = new_path(spark, "linear")
    pipe.df.write.parquet(path)
    return Pipe(spark.read.schema(pipe.df.schema).parquet(path), pipe.items, pipe.params)
