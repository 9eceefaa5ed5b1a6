"""Closures with mutable state: one state a partition, built once and passed to every closure.

All closures up to ``into`` run in one Python stage over Arrow batches. Results may depend on
how rows are dealt to partitions, and a repeated task starts from a fresh state.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weirflow.operators.fallible import ERR, OptionPipe, ResultPipe
from weirflow.operators.params import IterationOrder
from weirflow.operators.pipe import Pipe
from weirflow.plans.order import ORD, extended


def clone_of(value: object) -> Callable[[int], object]:
    return lambda _: copy.deepcopy(value)


@dataclass(frozen=True)
class UsingPipe:
    """Element-wise closures ``f(state, **values)``; ``into(schema)`` ends the stage and gives an ordinary pipeline."""

    source: Pipe
    make: Callable[[int], object]
    steps: tuple = field(default_factory=tuple)

    def _add(self, kind: str, f: Callable) -> UsingPipe:
        return replace(self, steps=(*self.steps, (kind, f)))

    def map(self, f: Callable) -> UsingPipe:
        """``f`` returns a dict of the new values."""
        return self._add("map", f)

    def filter(self, f: Callable) -> UsingPipe:
        return self._add("filter", f)

    def filter_map(self, f: Callable) -> UsingPipe:
        """``f`` returns a dict, or None for no element."""
        return self._add("filter_map", f)

    def flat_map(self, f: Callable) -> UsingPipe:
        """``f`` returns dicts."""
        return self._add("flat_map", f)

    def flatten(self, column: str) -> UsingPipe:
        return self._add("flat_map", lambda _, **x: [{column: v} for v in (x[column] if x[column] is not None else ())])

    def inspect(self, f: Callable) -> UsingPipe:
        return self._add("inspect", f)

    def copied(self) -> UsingPipe:
        return self

    cloned = copied

    def _through(self) -> Callable[[object, dict], list[dict]]:
        steps = self.steps

        def through(state: object, x: dict) -> list[dict]:
            rows = [x]
            for kind, f in steps:
                after: list[dict] = []
                for r in rows:
                    if kind == "inspect":
                        f(state, **r)
                        after.append(r)
                    elif kind == "filter":
                        after += [r] if f(state, **r) else []
                    elif kind == "flat_map":
                        after += list(f(state, **r))
                    else:
                        found = f(state, **r)
                        after += [] if found is None else [found]
                rows = after
            return rows

        return through

    def into(self, schema: str) -> Pipe:
        """The ordinary pipeline of the results, whose columns ``schema`` names; all its reductions and early exits follow."""
        names, out = list(self.source.items), StructType.fromDDL(schema).names
        make, through, params = self.make, self._through(), self.source.params

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state = make(TaskContext.get().partitionId())
            for batch in params.batches(batches):
                made, of, at = [], [], []
                for k, row in enumerate(batch[names].itertuples(index=False, name=None)):
                    for j, r in enumerate(through(state, dict(zip(names, row, strict=True)))):
                        made.append([r[n] for n in out])
                        of.append(k)
                        at.append(j)
                taken = batch.iloc[of].reset_index(drop=True)[[ORD]]
                yield pd.concat([taken, pd.DataFrame({"__at": at}, dtype="int32"), pd.DataFrame(made, columns=out)], axis=1)

        order = self.source.df.schema[ORD].dataType.simpleString()
        df = self.source.df.mapInPandas(work, f"{ORD} {order}, __at int, {schema}")
        return Pipe(df.select(extended(F.col("__at")).alias(ORD), *out), tuple(out), self.source.params)

    def into_fallible_result(self, f: Callable, schema: str) -> ResultPipe:
        """``f(state, **values)`` returns ``(values, None)`` or ``(None, error)``; elements with an error fail the whole computation."""
        names = StructType.fromDDL(schema).names

        def told(state: object, **x) -> dict:
            values, error = f(state, **x)
            return {**(values if error is None else dict.fromkeys(names)), ERR: error}

        made = self.map(told).into(f"{schema}, `{ERR}` string")
        return ResultPipe(made.df, tuple(names), made.params)

    def into_fallible_option(self, f: Callable, schema: str) -> OptionPipe:
        """``f(state, **values)`` returns the values, or None for an absent element, which makes the whole result absent."""
        names = StructType.fromDDL(schema).names

        def told(state: object, **x) -> dict:
            values = f(state, **x)
            return {**(dict.fromkeys(names) if values is None else values), ERR: values is None or None}

        made = self.map(told).into(f"{schema}, `{ERR}` boolean")
        return OptionPipe(made.df, tuple(names), made.params)

    def reduce(self, f: Callable, schema: str) -> DataFrame:
        """One row of ``schema``, NULLs for no elements: all results combined by ``f(state, a, b)``, associative, of values to values.

        Each task folds its rows, in order unless the order is arbitrary, with its own state; the
        tasks' results, one row each, are folded by one more task with a state of its own.
        """
        names, out = list(self.source.items), StructType.fromDDL(schema).names
        make, through, params = self.make, self._through(), self.source.params
        df = self.source.df
        if params.order is IterationOrder.ORDERED:
            df = df.repartitionByRange(ORD).sortWithinPartitions(ORD)

        def folding(columns: list[str], results: Callable[[object, dict], list[dict]]) -> Callable:
            def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                part = TaskContext.get().partitionId()
                state, held = make(part), None
                for batch in params.batches(batches):
                    for row in batch[columns].itertuples(index=False, name=None):
                        for x in results(state, dict(zip(columns, row, strict=True))):
                            held = x if held is None else f(state, held, x)
                if held is not None:
                    yield pd.DataFrame([[part, *(held[n] for n in out)]], columns=["__part", *out])

            return work

        partial = df.mapInPandas(folding(names, through), f"__part int, {schema}")
        # As many rows as there are tasks.
        whole = partial.repartition(1).sortWithinPartitions("__part").mapInPandas(folding(out, lambda _, x: [x]), f"__part int, {schema}")
        return whole.agg(F.first(F.struct(*out)).alias("x")).select(*(F.col("x")[n].alias(n) for n in out))

    def for_each(self, f: Callable) -> None:
        """``f(state, **values)`` for every result, on the executors."""
        make, through, names, params = self.make, self._through(), list(self.source.items), self.source.params

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state = make(TaskContext.get().partitionId())
            for batch in params.batches(batches):
                for row in batch[names].itertuples(index=False, name=None):
                    for x in through(state, dict(zip(names, row, strict=True))):
                        f(state, **x)
            yield from ()

        self.source.df.mapInPandas(work, "done int").write.format("noop").mode("overwrite").save()
