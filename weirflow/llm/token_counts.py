"""Token counts by heap-and-linked-list byte-pair merging, without making any identifiers' list.

Each pretoken starts as one symbol a byte in a doubly linked list; a heap holds the adjacent
pairs that can merge as (rank, place). The lowest is popped, skipped if it is out of date,
and otherwise merged, and the two new neighbours' pairs are pushed. The count is the initial
number of symbols minus the number of merges.

Nulls are empty texts with no tokens. Repeated rows count alike. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm import vocabulary as vocab
from weirflow.llm.common import slices

#: Pretokens a worker remembers; beyond that it starts over.
REMEMBERED = 1_000_000


class Counter:
    def __init__(self, path: str):
        self.vocabulary = vocab.load(path)
        self.byte_ids = self.vocabulary.byte_ids.tolist()
        self.known: dict[str, int] = {}

    def merged_count(self, raw: bytes) -> int:
        """Symbols left of one pretoken after all merges."""
        n = len(raw)
        if n < 2:
            return n
        merges = self.vocabulary.merges
        symbol = [self.byte_ids[b] for b in raw]
        heap = []
        for i in range(n - 1):
            found = merges.get((symbol[i], symbol[i + 1]))
            if found:
                heap.append((found[0], i, found[1]))
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        count = n
        while heap:
            rank, i, merged = heappop(heap)
            j = after[i]
            if symbol[i] < 0 or j >= n:
                continue
            found = merges.get((symbol[i], symbol[j]))
            if not found or found[0] != rank:
                continue
            symbol[i], symbol[j] = merged, -1
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get((merged, symbol[k]))
                if found:
                    heappush(heap, (found[0], i, found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbol[h], merged))
                if found:
                    heappush(heap, (found[0], h, found[1]))
        return count

    def count(self, text: str) -> int:
        parts = vocab.segments(self.vocabulary, text)
        known, total = self.known, len(parts) // 2
        for part in parts[::2]:
            words = self.vocabulary.pattern.findall(part)
            for w in set(words):
                if w not in known:
                    known[w] = self.merged_count(w.encode("utf-8", "surrogatepass"))
            total += sum(map(known.__getitem__, words))
            if len(known) > REMEMBERED:
                known.clear()
        return total


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 512, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, then ``n_bytes``, ``n_tokens`` and ``over_limit``; one pass, no shuffle."""
    path = path or vocab.default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _counters.get(path) or _counters.setdefault(path, Counter(path))
        for batch in batches:
            for part in slices(batch, "__text"):
                counts = [own.count(t) for t in part.column("__text").to_pylist()]
                n_bytes = pc.binary_length(part.column("__text")).cast(pa.int64())
                out = [*(part.column(k) for k in range(len(keep))), n_bytes, pa.array(counts, pa.int64()), pa.array([c > limit for c in counts])]
                yield pa.RecordBatch.from_arrays(out, names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), "n_bytes bigint", "n_tokens bigint", "over_limit boolean"])
    return docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text")).mapInArrow(work, schema)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than 512 tokens) of every whole text."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
