"""Element-wise stages over streams: map, filter, filter_map, flat_map, flatten and inspect run unchanged
on a streaming DataFrame. Operators that need the whole order (prefixes, enumerate, sorted collection,
reductions) do not exist on a stream that has not ended, and are refused."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from weirflow.operators.pipe import Pipe

ELEMENT_WISE = ("map", "filter", "filter_map", "flat_map", "flatten", "inspect", "copied", "cloned")


class StreamPipe:
    """A pipeline over ``readStream``; ends in ``to_df`` and ``writeStream``."""

    def __init__(self, pipe: Pipe):
        self._pipe = pipe

    @classmethod
    def over(cls, df: DataFrame, key: list[str], items: list[str] | None = None) -> StreamPipe:
        if not df.isStreaming:
            raise ValueError("not a streaming DataFrame")
        return cls(Pipe.over(df, key, items))

    def __getattr__(self, name: str) -> Callable[..., StreamPipe]:
        if name not in ELEMENT_WISE:
            raise AttributeError(f"{name} is not defined on a stream; element-wise operators are {ELEMENT_WISE}")
        return lambda *args, **kwargs: StreamPipe(getattr(self._pipe, name)(*args, **kwargs))

    def to_df(self) -> DataFrame:
        return self._pipe.to_df()
