"""The ordered, lazy pipeline over a DataFrame.

Every operator gives what a run from left to right over the rows in key order would give, also
where several answers would be allowed. Closures take the items' columns and return columns, so
that Catalyst sees through them: filters reach the scan, maps fuse into one projection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weirflow.functions import monoid
from weirflow.operators.params import IterationOrder, Params, environment_bound
from weirflow.plans.order import ORD, dense_index, extended, key_of, tree_fold


class Item:
    """The columns of one element, by name or attribute."""

    def __init__(self, names: list[str], at: Callable[[str], Column] = F.col):
        self._names, self._at = names, at

    def __getitem__(self, name: str) -> Column:
        if name not in self._names:
            raise KeyError(f"{name!r} is not among {self._names}")
        return self._at(name)

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    @property
    def value(self) -> Column:
        """The column of that name or the only one, or all of them as a struct."""
        if "value" in self._names:
            return self._at("value")
        return self._at(self._names[0]) if len(self._names) == 1 else F.struct(*(self._at(n).alias(n) for n in self._names))


Outputs = Column | dict[str, Column]


@dataclass(frozen=True)
class Maybe:
    """What filter_map and map_while return: whether there is a value, and the value (NULL is a value)."""

    present: Column
    value: Outputs


def named(out: Outputs) -> dict[str, Column]:
    return out if isinstance(out, dict) else {"value": out}


def true(predicate: Column) -> Column:
    """NULL counts as false."""
    return F.coalesce(predicate, F.lit(False))


@dataclass(frozen=True)
class Pipe:
    """Rows with an order key and item columns. Made by ``par`` and its kin in ``weirflow.sources``."""

    df: DataFrame
    items: tuple[str, ...]
    params: Params = Params()

    @classmethod
    def over(cls, df: DataFrame, key: list[str], items: list[str] | None = None) -> Pipe:
        """``key`` must be unique over the rows; items are all columns unless named."""
        items = list(items if items is not None else df.columns)
        pipe, bound = cls(df.select(key_of(key), *items), tuple(items)), environment_bound()
        return pipe.num_threads(bound) if bound else pipe

    # -- knobs

    def num_threads(self, n: int) -> Pipe:
        """At most ``n`` tasks from here on; 1 is sequential, 0 the session's choice."""
        if n < 0:
            raise ValueError("num_threads must not be negative")
        df = self.df.coalesce(n) if n and not self.df.isStreaming else self.df
        return replace(self, df=df, params=replace(self.params, num_threads=n))

    def chunk_size(self, n: int) -> Pipe:
        if n < 0:
            raise ValueError("chunk_size must not be negative")
        return replace(self, params=replace(self.params, chunk_size=n))

    def iteration_order(self, order: IterationOrder | str) -> Pipe:
        return replace(self, params=replace(self.params, order=IterationOrder(order)))

    def with_pool(self, name: str) -> Pipe:
        """Jobs that this thread starts from now on run in the scheduler pool ``name``."""
        self.df.sparkSession.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        return self

    def with_runner(self, run: Callable[[DataFrame], DataFrame]) -> Pipe:
        """The stages so far as ``run`` wants them computed: a function of their DataFrame to one of the same rows and columns.

        Spark's scheduler deals out tasks itself; what a caller can choose is where a stage ends and
        how its rows are spread (``repartition``, ``persist``, a written table, hints).
        """
        df = run(self.df)
        if df.columns != self.df.columns:
            raise ValueError("a runner must keep the columns")
        return replace(self, df=df)

    def diagnostics(self) -> DataFrame:
        """One row a task: (partition, rows, calls, mean_batch, largest_batch) of the batches that Python closures are handed."""
        params = self.params

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            sizes = [len(b) for b in params.batches(batches)]
            row = (TaskContext.get().partitionId(), sum(sizes), len(sizes), sum(sizes) / len(sizes) if sizes else 0.0, max(sizes, default=0))
            yield pd.DataFrame([row], columns=["partition", "rows", "calls", "mean_batch", "largest_batch"])

        return self.df.select(F.lit(1).alias("x")).mapInPandas(work, "partition int, rows bigint, calls bigint, mean_batch double, largest_batch bigint")

    # -- element-wise

    @property
    def item(self) -> Item:
        return Item(list(self.items))

    def _with(self, out: dict[str, Column], order: Column | None = None, source: DataFrame | None = None) -> Pipe:
        df = (self.df if source is None else source).select((F.col(ORD) if order is None else order).alias(ORD), *(c.alias(n) for n, c in out.items()))
        return replace(self, df=df, items=tuple(out))

    def map(self, f: Callable[[Item], Outputs]) -> Pipe:
        return self._with(named(f(self.item)))

    def filter(self, predicate: Callable[[Item], Column]) -> Pipe:
        return replace(self, df=self.df.where(predicate(self.item)))

    def filter_map(self, f: Callable[[Item], Maybe]) -> Pipe:
        found = f(self.item)
        values = named(found.value)
        df = self.df.select(ORD, found.present.alias("__present"), *(c.alias(n) for n, c in values.items())).where("__present")
        return replace(self, df=df.drop("__present"), items=tuple(values))

    def flat_map(self, f: Callable[[Item], Column], name: str = "value") -> Pipe:
        """One row for each element of the array that ``f`` returns, in its order; none for NULL or empty arrays."""
        df = self.df.select(ORD, F.posexplode(f(self.item)).alias("__at", name))
        return replace(self, df=df.select(extended(F.col("__at")).alias(ORD), name), items=(name,))

    def flatten(self, column: str | None = None) -> Pipe:
        column = column or self.items[0]
        return self.flat_map(lambda x: x[column], column)

    def inspect(self, observation: Observation | str, **metrics: Column) -> Pipe:
        """Rows pass unchanged; the metrics are computed on the way and read from the observation."""
        return replace(self, df=self.df.observe(observation, *(c.alias(n) for n, c in metrics.items())))

    def copied(self) -> Pipe:
        return self

    cloned = copied

    def enumerate(self, name: str = "index") -> Pipe:
        """Adds the 0-based position."""
        df = dense_index(self.df, name)
        return replace(self, df=df.select(ORD, name, *self.items), items=(name, *self.items))

    def chain(self, other: Pipe) -> Pipe:
        """All of this, then all of ``other``; keys of both may differ in type, knobs are this one's."""
        a, b = self.df.schema[ORD].dataType.simpleString(), other.df.schema[ORD].dataType.simpleString()
        left = self.df.withColumn(ORD, F.struct(F.lit(0).alias("part"), F.col(ORD).alias("a"), F.lit(None).cast(b).alias("b")))
        right = other.df.withColumn(ORD, F.struct(F.lit(1).alias("part"), F.lit(None).cast(a).alias("a"), F.col(ORD).alias("b")))
        return replace(self, df=left.unionByName(right))

    # -- ordered prefixes

    def _before(self, df: DataFrame, stops: Column) -> DataFrame:
        """Rows before the first one at which ``stops`` holds; all where there is none."""
        first = df.where(stops).agg(F.min(F.struct(F.col(ORD).alias("o"))).alias("stop"))
        return df.where(F.coalesce(F.struct(F.col(ORD).alias("o")) < first.scalar(), F.lit(True)))

    def take_while(self, predicate: Callable[[Item], Column]) -> Pipe:
        return replace(self, df=self._before(self.df, ~true(predicate(self.item))))

    def map_while(self, f: Callable[[Item], Maybe]) -> Pipe:
        found = f(self.item)
        values = named(found.value)
        df = self.df.select(ORD, true(found.present).alias("__present"), *(c.alias(n) for n, c in values.items()))
        return replace(self, df=self._before(df, ~F.col("__present")).select(ORD, *values), items=tuple(values))

    # -- opaque closures

    def map_py(self, f: Callable[..., tuple | object], schema: str) -> Pipe:
        """A Python function of an element's values (by keyword) to the values of ``schema``."""
        return self.flat_map_py(lambda **x: [f(**x)], schema, single=True)

    def filter_py(self, f: Callable[..., bool]) -> Pipe:
        schema = ", ".join(f"`{n}` {self.df.schema[n].dataType.simpleString()}" for n in self.items)
        names, params = list(self.items), self.params

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in params.batches(batches):
                yield batch[[bool(f(**dict(zip(names, row, strict=True)))) for row in batch[names].itertuples(index=False, name=None)]]

        df = self.df.mapInPandas(work, f"{ORD} {self.df.schema[ORD].dataType.simpleString()}, {schema}")
        return replace(self, df=df)

    def flat_map_py(self, f: Callable[..., list], schema: str, single: bool = False) -> Pipe:
        """Like ``map_py``, with any number of outputs for each element."""
        from pyspark.sql.types import StructType

        names, out = list(self.items), StructType.fromDDL(schema).names

        def spread(batch: pd.DataFrame) -> pd.DataFrame:
            rows, of, at = [], [], []
            for k, row in enumerate(batch[names].itertuples(index=False, name=None)):
                for j, value in enumerate(f(**dict(zip(names, row, strict=True)))):
                    rows.append(value if isinstance(value, tuple) else (value,))
                    of.append(k)
                    at.append(j)
            made = pd.DataFrame(rows, columns=out)
            taken = batch.iloc[of].reset_index(drop=True)
            return pd.concat([taken[[ORD]], pd.DataFrame({"__at": at}, dtype="int32"), made], axis=1)

        order, params = self.df.schema[ORD].dataType.simpleString(), self.params

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in params.batches(batches):
                yield spread(batch)

        df = self.df.mapInPandas(work, f"{ORD} {order}, __at int, {schema}")
        key = F.col(ORD) if single else extended(F.col("__at"))
        return replace(self, df=df.select(key.alias(ORD), *out), items=tuple(out))

    # -- collecting

    def to_df(self) -> DataFrame:
        """The items, in no particular order."""
        return self.df.select(*self.items)

    def collect(self) -> DataFrame:
        """The items, sorted by the key unless the order is arbitrary."""
        ordered = self.params.order is IterationOrder.ORDERED
        return (self.df.orderBy(ORD) if ordered else self.df).select(*self.items)

    def collect_into(self, existing: Pipe) -> Pipe:
        """``existing``, then these."""
        return existing.chain(self)

    def for_each(self, f: Callable[[Iterator], None]) -> None:
        """Runs ``f`` on the rows of each partition, on the executors; in any order."""
        self.to_df().foreachPartition(f)

    # -- reductions: DataFrames of one row

    def _value(self, column: str | None) -> Column:
        return F.col(column) if column else self.item.value

    def reduce(self, f: str | Callable[[Column, Column], Column], column: str | None = None, commutative: bool = False, name: str = "value") -> DataFrame:
        """All items combined, NULL for none. ``f``: a name of ``weirflow.functions.MONOIDS``, or a function of two
        columns that is associative, and with ``commutative`` commutative too."""
        item = self._value(column)
        if isinstance(f, str):
            return self.df.agg(monoid(f, item).alias(name))
        return tree_fold(self.df, item, f, not commutative).withColumnRenamed("value", name)

    def sum(self, column: str | None = None, name: str = "value") -> DataFrame:
        item = self._value(column)
        return self.df.agg(F.coalesce(F.sum(item), F.lit(0)).alias(name))

    def count(self, name: str = "value") -> DataFrame:
        return self.df.agg(F.count("*").alias(name))

    def min(self, column: str | None = None, name: str = "value") -> DataFrame:
        return self.df.agg(F.min(self._value(column)).alias(name))

    def max(self, column: str | None = None, name: str = "value") -> DataFrame:
        return self.df.agg(F.max(self._value(column)).alias(name))

    def _one(self, picked: DataFrame) -> DataFrame:
        """At least one row: NULLs for none."""
        whole = F.struct(*(F.col(n).alias(n) for n in self.items))
        return picked.agg(F.first(whole).alias("__item")).select(*(F.col("__item")[n].alias(n) for n in self.items))

    def min_by_key(self, key: Callable[[Item], Column]) -> DataFrame:
        """The first item with the least key."""
        return self._one(self.df.orderBy(key(self.item).asc_nulls_first(), ORD).limit(1))

    def max_by_key(self, key: Callable[[Item], Column]) -> DataFrame:
        """The first item with the largest key."""
        return self._one(self.df.orderBy(key(self.item).desc_nulls_last(), ORD).limit(1))

    def _by(self, compare: Callable[[Item, Item], Column], sign: int) -> DataFrame:
        whole = F.struct(F.col(ORD).alias("o"), *(F.col(n).alias(n) for n in self.items))
        names = list(self.items)

        def better(x: Column, y: Column) -> Column:
            c = sign * compare(Item(names, lambda n: x[n]), Item(names, lambda n: y[n]))
            return F.when((c < 0) | ((c == 0) & (x["o"] < y["o"])), x).otherwise(y)

        folded = tree_fold(self.df, whole, better, ordered=False)
        return folded.select(*(F.col("value")[n].alias(n) for n in names))

    def min_by(self, compare: Callable[[Item, Item], Column]) -> DataFrame:
        """``compare``: negative, zero or positive; the first of the least items."""
        return self._by(compare, 1)

    def max_by(self, compare: Callable[[Item, Item], Column]) -> DataFrame:
        return self._by(compare, -1)

    def all(self, predicate: Callable[[Item], Column], name: str = "value") -> DataFrame:
        return self.df.agg(F.coalesce(F.bool_and(true(predicate(self.item))), F.lit(True)).alias(name))

    def any(self, predicate: Callable[[Item], Column], name: str = "value") -> DataFrame:
        return self.df.agg(F.coalesce(F.bool_or(true(predicate(self.item))), F.lit(False)).alias(name))

    # -- early exit: one row, NULLs where there is none

    def first(self) -> DataFrame:
        ordered = self.params.order is IterationOrder.ORDERED
        return self._one((self.df.orderBy(ORD) if ordered else self.df).limit(1))

    def find(self, predicate: Callable[[Item], Column]) -> DataFrame:
        return self.filter(predicate).first()

    # -- other kinds of pipelines

    def into_fallible_result(self, ok: Callable[[Item], Outputs], err: Callable[[Item], Column]):
        """Elements whose ``err`` is not NULL fail the whole computation with it."""
        from weirflow.operators.fallible import ResultPipe

        values = named(ok(self.item))
        df = self.df.select(ORD, err(self.item).alias("__err"), *(c.alias(n) for n, c in values.items()))
        return ResultPipe(df, tuple(values), self.params)

    def into_fallible_option(self, f: Callable[[Item], Maybe]):
        """Elements that are not present make the whole computation's result absent."""
        from weirflow.operators.fallible import OptionPipe

        found = f(self.item)
        values = named(found.value)
        df = self.df.select(ORD, F.when(~true(found.present), F.lit(True)).alias("__err"), *(c.alias(n) for n, c in values.items()))
        return OptionPipe(df, tuple(values), self.params)

    def using(self, make: Callable[[int], object]):
        """Closures that follow share one state a partition, made from the partition's number."""
        from weirflow.operators.using import UsingPipe

        return UsingPipe(self, make)

    def using_clone(self, value: object):
        from weirflow.operators.using import UsingPipe, clone_of

        return UsingPipe(self, clone_of(value))
