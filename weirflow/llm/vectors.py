"""Embedding near-dedup with a pivot-permutation index.

Every vector is described by its nearest reference points ("pivots") in order and stands in the
inverted list of each of them. Vectors that stand together in at least two lists are candidates;
candidates are verified by cosine in double precision. Counting shared pivots comes first: within
a list, only members that share a second pivot are multiplied, and a pair is taken where its two
lowest shared pivots meet, so it is counted once.

Each length of vectors has an index of its own, fitted on a sample of at most ``SAMPLE`` vectors or
two a pivot. Pivots are picked from it by farthest point; their number follows the root of the row
count. How many of them are used and how many describe a vector is calibrated: the cheapest pair
of numbers for which at least ``RECALL`` of the sample's true pairs, and of pairs made exactly at
the threshold in directions of the data, share two pivots. One pivot for all, a list in which every
pair is compared, is always among the choices, so data that no pivots can part (vectors of low
spread) are compared whole. ``exact=True`` asks for that one.

Exact copies are one representative with a multiplicity before anything else. A long list is cut
up by the second pivot, and what is still long into blocks by a hash; each pair of blocks is one
task's work, done as matrix products: it gives link counts by vector and a spanning forest of its
links, never the pairs themselves. Members that share a lower pair of pivots anyway are skipped
as groups, so a dense cluster is multiplied once and not in all its lists.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing and are kept; vectors of different lengths do not link. Repeated ids are vectors of their
own, a repeated row links with its copy; a null id is never the smallest while there is another.
Ties between pivots go to the lower number. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm import common

#: Vectors of a length on which its index is fitted (or two a pivot), and most pivots.
SAMPLE, MOST_PIVOTS = 4096, 4096
#: A length with fewer vectors has one list.
FEW = 256
#: Numbers of nearest pivots that may describe a vector; share of the sample's pairs that has to be found; most of them that are tried.
PREFIXES, RECALL, PAIRS = (4, 6, 8, 12, 16, 24, 32), 0.995, 20_000
#: Vectors of a list that are one block.
BLOCK = 2048
#: What a copy of a vector in a list costs, in products of two vectors.
COPY = 200


def usable(vector: str = "embedding"):
    """Neither null nor zero, without null or non-finite components."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def farthest_points(x: np.ndarray, most: int) -> np.ndarray:
    """Places of at most so many unit vectors, each the one farthest from all before; the first has the least sum of products."""
    if not len(x):
        return np.zeros(0, np.int64)
    chosen = [int(np.argmin(x @ x.sum(0)))]
    nearest = x @ x[chosen[0]]
    while len(chosen) < most:
        k = int(np.argmin(nearest))
        if nearest[k] > 1 - 1e-9:
            break
        chosen.append(k)
        nearest = np.maximum(nearest, x @ x[k])
    return np.array(chosen)


def _members(products: np.ndarray, prefix: int) -> np.ndarray:
    """Which pivots are among the ``prefix`` nearest, by row."""
    out = np.zeros(products.shape, bool)
    np.put_along_axis(out, np.argpartition(-products, prefix - 1, axis=1)[:, :prefix], True, axis=1)
    return out


def fit_index(sample: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, int]:
    """Pivots and length of descriptions for ``n`` vectors like the unit vectors of ``sample``; one pivot stands for no parting."""
    want = min(MOST_PIVOTS, max(16, 1 << round(math.log2(max(2.0, math.sqrt(n))))))
    pivots = sample[farthest_points(sample, want)]
    trial = sample[:2048]
    products = (trial @ pivots.T).astype(np.float32)
    close = np.argwhere(np.triu(trial @ trial.T >= threshold, 1))
    close = close[:: max(1, -(-len(close) // PAIRS))]
    # A partner of each vector at the threshold exactly, towards another vector of the sample.
    other = np.roll(trial, 1 + len(trial) // 3, axis=0)
    aside = other - (other * trial).sum(1, keepdims=True) * trial
    length = np.linalg.norm(aside, axis=1)
    moved = np.flatnonzero(length > 1e-6)
    aside = aside[moved] / length[moved, None]
    partner = threshold * products[moved] + math.sqrt(max(0.0, 1 - threshold**2)) * (aside @ pivots.T).astype(np.float32)
    best = (float(n) + COPY, 1, 1)
    size = 4
    while size <= len(pivots):
        for prefix in PREFIXES:
            if prefix > size or COPY * prefix >= best[0]:
                break
            own = _members(products[:, :size], prefix)
            both = (own[moved] & _members(partner[:, :size], prefix)).sum(1) >= 2
            true = (own[close[:, 0]] & own[close[:, 1]]).sum(1) >= 2
            if any(len(x) and x.mean() < RECALL for x in (both, true)):
                continue
            together = own.T.astype(np.float32) @ own.astype(np.float32) / len(own)
            work = float((np.triu(together, 1) ** 2).sum()) * n
            best = min(best, (work + COPY * prefix + size, size, prefix))
            break  # longer descriptions cost more
        size = len(pivots) if size < len(pivots) < 2 * size else 2 * size
    return pivots[: best[1]], best[2]


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def indexes(reps: DataFrame, threshold: float, exact: bool = False) -> dict[int, tuple[np.ndarray, int]]:
    """An index for each length of which there are ``FEW`` vectors or more; bounded by the sample a length."""
    sizes = {r["size"]: r["count"] for r in reps.groupBy(F.size("vector").alias("size")).count().collect()}
    out = {}
    for size, n in sorted(sizes.items()):
        if n < FEW or exact:
            continue
        most = max(SAMPLE, 2 * min(MOST_PIVOTS, math.isqrt(n)))
        rows = reps.where(F.size("vector") == size).orderBy(F.xxhash64(F.lit(7), "node"), "node").limit(most).select("vector").toArrow()
        flat = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        out[size] = fit_index(_units(flat.reshape(-1, size)), n, threshold)
    return out


def describe(reps: DataFrame, found: dict[int, tuple[np.ndarray, int]]) -> DataFrame:
    """node, copies, the vector's length and bytes, its nearest pivots in order, and whether two have to be shared."""
    shared = reps.sparkSession.sparkContext.broadcast(found)
    kind = np.float32 if reps.schema["vector"].dataType.elementType.simpleString() == "float" else np.float64

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                x = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, size)
                pivots, prefix = shared.value.get(size, (None, 1))
                if pivots is None or len(pivots) == 1:
                    near = np.zeros((len(x), 1), np.int32)
                else:
                    near = np.argsort(-(_units(x) @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel()))
                columns = [part.column("node"), part.column("copies"), pa.array(np.full(len(x), size), pa.int32()), pa.array([row.tobytes() for row in x], pa.binary()), lists, pa.array(np.full(len(x), near.shape[1] > 1))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "copies", "size", "raw", "near", "two"])

    return reps.select("node", "copies", "vector").mapInArrow(work, "node bigint, copies bigint, size int, raw binary, near array<int>, two boolean")


class _Links:
    """Links among the members of a task: how many each has, and a spanning forest."""

    def __init__(self, node: np.ndarray, copies: np.ndarray):
        self.node, self.copies = node, copies
        self.n, self.label = np.zeros(len(node), np.int64), np.arange(len(node))
        self.spans: list[np.ndarray] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.n, i, self.copies[j])
        np.add.at(self.n, j, self.copies[i])
        while True:
            open_ = self.label[i] != self.label[j]
            i, j = i[open_], j[open_]
            if not len(i):
                return
            # Each label hooks onto a lower one, by one link.
            high, first = np.unique(np.maximum(self.label[i], self.label[j]), return_index=True)
            onto = np.arange(len(self.label))
            onto[high] = np.minimum(self.label[i], self.label[j])[first]
            self.spans.append(np.stack([self.node[i[first]], self.node[j[first]]]))
            while (onto[onto] != onto).any():
                onto = onto[onto]
            self.label = onto[self.label]


def _compare(found: _Links, unit: np.ndarray, near: np.ndarray, x: np.ndarray, y: np.ndarray, pivot: int, second: int, threshold: float) -> None:
    """Links between members ``x`` and ``y`` (the same, or apart) whose two lowest shared pivots are these; a negative ``second`` takes all."""
    if second >= 0:
        low = np.sort(np.where((near < second) & (near != pivot), near, -1), axis=1)
        if x is y and len(x) > 64:  # groups with the same lower pivots meet at those
            kinds, of = np.unique(low[x], axis=0, return_inverse=True)
            if len(kinds) == 1 and kinds.max() >= 0:
                return
    for start in range(0, len(x), 256):
        a = x[start : start + 256]
        close = unit[a] @ unit[y].T >= threshold
        if x is y:
            close &= np.arange(start, start + len(a))[:, None] < np.arange(len(y))
        i, j = np.nonzero(close)
        step = 1 << 15
        for at in range(0, len(i), step):
            p, q = a[i[at : at + step]], y[j[at : at + step]]
            if second >= 0:
                u, v = low[p], low[q]
                met = np.zeros(len(p), bool)
                for k in range(u.shape[1]):
                    met |= (u[:, k] >= 0) & (u[:, k, None] == v).any(1)
                p, q = p[~met], q[~met]
            found.add(p, q)


def links(described: DataFrame, threshold: float = 0.95, block: int | None = None) -> DataFrame:
    """Rows (node, n, other): ``n`` links of ``node`` found by one task, or with ``n`` 0 a spanning link to ``other``."""
    block = block or BLOCK
    members = described.withColumn("pivot", F.explode("near"))
    sizes = members.groupBy("size", "pivot").agg(F.count("*").alias("length"))
    # A short list goes to one task, a long one is cut by the second pivot.
    second = F.when(~F.col("two"), F.array(F.lit(-2))).when(F.col("length") <= block, F.array(F.lit(-1))).otherwise(F.filter("near", lambda q: q > F.col("pivot")))
    members = members.join(sizes, ["size", "pivot"]).withColumn("second", F.explode(second)).drop("length")
    counts = members.groupBy("size", "pivot", "second").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    members = members.join(counts, ["size", "pivot", "second"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.withColumns({"lo": F.least("own", "with"), "hi": F.greatest("own", "with")})
    kind_of = lambda table: np.float32 if len(table.column("raw")[0].as_py()) == 4 * table.column("size")[0].as_py() else np.float64

    def work(table: pa.Table) -> pa.Table:
        own, node, copies = (table.column(c).to_numpy() for c in ("own", "node", "copies"))
        lo, hi, pivot, second = (table.column(c)[0].as_py() for c in ("lo", "hi", "pivot", "second"))
        unit = _units(np.frombuffer(b"".join(table.column("raw").to_pylist()), kind_of(table)).reshape(len(own), -1))
        near = table.column("near").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
        found = _Links(node, copies)
        x, y = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        if second == -1:
            for q in np.unique(near[near > pivot]).tolist():
                x = np.flatnonzero((near == q).any(1))
                _compare(found, unit, near, x, x, pivot, q, threshold)
        else:
            _compare(found, unit, near, x, x if lo == hi else y, pivot, second, threshold)
        some = np.flatnonzero(found.n)
        spans = np.concatenate([np.zeros((2, 0), np.int64), *found.spans], 1)
        nodes, n = np.concatenate([node[some], spans[0]]), np.concatenate([found.n[some], np.zeros(spans.shape[1], np.int64)])
        other = np.concatenate([np.zeros(len(some), np.int64), spans[1]])
        return pa.table({"node": nodes, "n": n, "other": pa.array(other, mask=n > 0)})

    members = members.select("node", "copies", "size", "raw", "near", "pivot", "second", "own", "lo", "hi")
    return members.groupBy("size", "pivot", "second", "lo", "hi").applyInArrow(work, "node bigint, n bigint, other bigint")


def near_duplicates(rows: DataFrame, threshold: float = 0.95, vector: str = "embedding", key: str = "vec_id", exact: bool = False) -> DataFrame:
    """One row a vector: ``key``, n_links, component_id, kept. ``exact`` compares all vectors of a length in blocks."""
    every = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("vector"))
    every = every.withColumn("digest", F.when(usable("vector"), F.sha2(F.col("vector").cast("string"), 256)))
    # Different vectors are the vertices, numbered by their digests (at V vectors some pair collides with chance V**2 / 2**65).
    reps = every.where("digest is not null").groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    reps = common.materialize(reps.withColumn("node", F.xxhash64("digest")), "vectors")
    described = common.materialize(describe(reps, indexes(reps, threshold, exact)), "vector-index")
    found = common.materialize(links(described, threshold), "vector-links")
    counts = found.where("n > 0").groupBy("node").agg(F.sum("n").alias("n"))
    components = common.connected_components(found.where("n = 0").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = reps.select("digest", "node", "id", "copies").join(counts, "node", "left").join(components, "node", "left")
    known = common.materialize(known.select("digest", "id", "component", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n")), "vector-known")
    lowest = known.where("component is not null").groupBy("component").agg(F.min("id").alias("lowest"))
    known = known.join(lowest, "component", "left").select("digest", "n", F.coalesce("lowest", known["id"]).alias("component"))
    out = every.select("id", "digest").join(known, "digest", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def op7_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all ``embeddings`` at a cosine of 0.95."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
