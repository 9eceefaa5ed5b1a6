"""Knobs that every pipeline carries."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from enum import Enum

import pandas as pd

#: Environment variable with the most tasks at a time of every pipeline; unset, empty or 0: no bound.
BOUND = "WEIRFLOW_NUM_THREADS"


class IterationOrder(Enum):
    """``ORDERED``: results in the order of the input. ``ARBITRARY``: no final sort, any element for first and find."""

    ORDERED = "ordered"
    ARBITRARY = "arbitrary"


@dataclass(frozen=True)
class Params:
    """``num_threads``: most tasks at a time that a pipeline's stages have (0: the session's choice).
    ``chunk_size``: most rows of a batch handed to Python closures (0: the session's choice); results do not depend on either."""

    num_threads: int = 0
    chunk_size: int = 0
    order: IterationOrder = IterationOrder.ORDERED

    @property
    def sequential(self) -> bool:
        return self.num_threads == 1

    def batches(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The same rows in batches of at most ``chunk_size``."""
        for batch in batches:
            step = self.chunk_size or max(1, len(batch))
            for at in range(0, len(batch), step):
                yield batch.iloc[at : at + step].reset_index(drop=True)


def environment_bound() -> int:
    """The bound that the environment sets, 0 for none."""
    value = os.environ.get(BOUND, "").strip() or "0"
    if not value.isdigit():
        raise ValueError(f"{BOUND} must be a number, not {value!r}")
    return int(value)
