"""Pipelines of elements that may fail: values count only if no element fails.

A failed element is a row whose ``__err`` is not NULL; filters and expansions keep it. The error
that is reported is the first in key order; for first, find, all and any an error after the
element that decides is not observed, as a run from left to right would stop there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions import monoid
from weirflow.operators.params import IterationOrder, Params
from weirflow.operators.pipe import Item, Maybe, Outputs, named, true
from weirflow.plans.order import ORD, extended, tree_fold

ERR = "__err"


@dataclass(frozen=True)
class ResultPipe:
    """Terminals give one row: the value (NULL if anything failed) and ``err``; ``collect`` gives rows, none if anything failed."""

    df: DataFrame
    items: tuple[str, ...]
    params: Params = Params()

    # -- knobs

    def num_threads(self, n: int):
        return replace(self, df=self.df.coalesce(n) if n else self.df, params=replace(self.params, num_threads=n))

    def chunk_size(self, n: int):
        return replace(self, params=replace(self.params, chunk_size=n))

    def iteration_order(self, order: IterationOrder | str):
        return replace(self, params=replace(self.params, order=IterationOrder(order)))

    def with_pool(self, name: str):
        self.df.sparkSession.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        return self

    # -- transformations of the values

    @property
    def item(self) -> Item:
        return Item(list(self.items))

    @property
    def _failed(self) -> Column:
        return F.col(ERR).isNotNull()

    def _guarded(self, c: Column) -> Column:
        return F.when(~self._failed, c)

    def map(self, f: Callable[[Item], Outputs]):
        out = named(f(self.item))
        return replace(self, df=self.df.select(ORD, ERR, *(self._guarded(c).alias(n) for n, c in out.items())), items=tuple(out))

    def filter(self, predicate: Callable[[Item], Column]):
        return replace(self, df=self.df.where(self._failed | predicate(self.item)))

    def filter_map(self, f: Callable[[Item], Maybe]):
        found = f(self.item)
        out = named(found.value)
        df = self.df.select(ORD, ERR, (self._failed | true(found.present)).alias("__present"), *(self._guarded(c).alias(n) for n, c in out.items()))
        return replace(self, df=df.where("__present").drop("__present"), items=tuple(out))

    def flat_map(self, f: Callable[[Item], Column], name: str = "value"):
        """Each value's elements; a failed element stays one row."""
        array = F.when(self._failed, F.array(F.lit(None))).otherwise(f(self.item))
        df = self.df.select(ORD, ERR, F.posexplode(array).alias("__at", name))
        return replace(self, df=df.select(extended(F.col("__at")).alias(ORD), ERR, name), items=(name,))

    def inspect(self, observation, **metrics: Column):
        return replace(self, df=self.df.observe(observation, *(c.alias(n) for n, c in metrics.items())))

    # -- outcome

    def error(self) -> DataFrame:
        """One row: the first error in key order, NULL if nothing failed."""
        return self.df.agg(F.min_by(ERR, F.when(self._failed, F.col(ORD))).alias("err"))

    def collect(self) -> DataFrame:
        """The values in order if nothing failed, no rows otherwise (see ``error``)."""
        failures = self.df.where(self._failed).select(F.lit(1).alias("f")).limit(1).agg(F.count("f").alias("n"))
        df = self.df.where(~self._failed).where(failures.scalar() == 0)
        ordered = self.params.order is IterationOrder.ORDERED
        return (df.orderBy(ORD) if ordered else df).select(*self.items)

    def collect_into(self, existing: DataFrame) -> DataFrame:
        """The rows of ``existing`` and then the values; no rows if anything failed."""
        failures = self.df.where(self._failed).agg(F.count("*").alias("n"))
        return existing.where(failures.scalar() == 0).unionByName(self.collect())

    def for_each(self, f) -> None:
        self.collect().foreachPartition(f)

    def _outcome(self, value: Column, name: str) -> DataFrame:
        """One aggregate: the value over all values if nothing failed, and the first error."""
        found = self.df.agg(F.min_by(ERR, F.when(self._failed, F.col(ORD))).alias("err"), value.alias("__v"))
        return found.select(F.when(F.col("err").isNull(), F.col("__v")).alias(name), "err")

    def _value(self, column: str | None) -> Column:
        return self._guarded(F.col(column) if column else self.item.value)

    def reduce(self, f, column: str | None = None, commutative: bool = False, name: str = "value") -> DataFrame:
        if isinstance(f, str):
            return self._outcome(monoid(f, self._value(column)), name)
        item = F.col(column) if column else self.item.value
        folded = tree_fold(self.df.where(~self._failed), item, f, not commutative)
        return self.error().select(F.when(F.col("err").isNull(), folded.scalar()).alias(name), "err")

    def sum(self, column: str | None = None, name: str = "value") -> DataFrame:
        return self._outcome(F.coalesce(F.sum(self._value(column)), F.lit(0)), name)

    def count(self, name: str = "value") -> DataFrame:
        return self._outcome(F.count(F.when(~self._failed, F.lit(1))), name)

    def min(self, column: str | None = None, name: str = "value") -> DataFrame:
        return self._outcome(F.min(self._value(column)), name)

    def max(self, column: str | None = None, name: str = "value") -> DataFrame:
        return self._outcome(F.max(self._value(column)), name)

    def _picked(self, picked: DataFrame) -> DataFrame:
        whole = F.struct(*(F.col(n).alias(n) for n in self.items))
        one = picked.agg(F.first(whole).alias("__item"))
        err = self.error()
        return err.select("err", one.scalar().alias("__item")).select(*(F.when(F.col("err").isNull(), F.col("__item")[n]).alias(n) for n in self.items), "err")

    def min_by_key(self, key: Callable[[Item], Column]) -> DataFrame:
        return self._picked(self.df.where(~self._failed).orderBy(key(self.item).asc_nulls_first(), ORD).limit(1))

    def max_by_key(self, key: Callable[[Item], Column]) -> DataFrame:
        return self._picked(self.df.where(~self._failed).orderBy(key(self.item).desc_nulls_last(), ORD).limit(1))

    def _by(self, compare, sign: int) -> DataFrame:
        from weirflow.operators.pipe import Pipe

        return self._picked(Pipe(self.df.where(~self._failed).drop(ERR), self.items)._by(compare, sign))

    def min_by(self, compare) -> DataFrame:
        return self._by(compare, 1)

    def max_by(self, compare) -> DataFrame:
        return self._by(compare, -1)

    def _decided(self, hit: Column) -> DataFrame:
        """One row: key of the first hit, its item, key of the first error, the error."""
        whole = F.struct(*(F.col(n).alias(n) for n in self.items))
        at = F.struct(F.col(ORD).alias("o"))
        hit = ~self._failed & true(hit)
        return self.df.agg(
            F.min(F.when(hit, at)).alias("hit"),
            F.min_by(whole, F.when(hit, at)).alias("item"),
            F.min(F.when(self._failed, at)).alias("bad"),
            F.min_by(ERR, F.when(self._failed, at)).alias("err"),
        ).withColumn("err", F.when(F.col("hit").isNull() | (F.col("bad") < F.col("hit")), F.col("err")))

    def all(self, predicate: Callable[[Item], Column], name: str = "value") -> DataFrame:
        found = self._decided(~true(predicate(self.item)))
        return found.select(F.when(F.col("err").isNull(), F.col("hit").isNull()).alias(name), "err")

    def any(self, predicate: Callable[[Item], Column], name: str = "value") -> DataFrame:
        found = self._decided(predicate(self.item))
        return found.select(F.when(F.col("err").isNull(), F.col("hit").isNotNull()).alias(name), "err")

    def find(self, predicate: Callable[[Item], Column]) -> DataFrame:
        found = self._decided(predicate(self.item))
        return found.select(*(F.when(F.col("err").isNull(), F.col("item")[n]).alias(n) for n in self.items), "err")

    def first(self) -> DataFrame:
        return self.find(lambda _: F.lit(True))  # an option's find tells of absence itself


@dataclass(frozen=True)
class OptionPipe(ResultPipe):
    """The same for absent elements; terminals give ``absent`` (whether any element is) in place of an error."""

    def _told(self, df: DataFrame) -> DataFrame:
        return df.select(*(c for c in df.columns if c != "err"), F.col("err").isNotNull().alias("absent"))


def _telling(name: str):
    inherited = getattr(ResultPipe, name)

    def terminal(self: OptionPipe, *args, **kwargs) -> DataFrame:
        return self._told(inherited(self, *args, **kwargs))

    terminal.__name__, terminal.__doc__ = name, inherited.__doc__
    return terminal


for _name in ("reduce", "sum", "count", "min", "max", "min_by_key", "max_by_key", "min_by", "max_by", "all", "any", "find"):
    setattr(OptionPipe, _name, _telling(_name))
