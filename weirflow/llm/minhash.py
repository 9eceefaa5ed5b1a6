"""MinHash near-dedup with ProbMinHash signatures, banding and verification.

A text's shingles are its runs of five words, weighed ``1 + ln(count)``. Each shingle is a
Poisson process whose rate is its weight; every arrival falls on one of ``REGISTERS`` registers,
each register keeps the shingle that arrived first, and a shingle stops once its next arrival
would come after every register's first. Two signatures agree in a register with the probability
Jaccard similarity of their texts. That may be far below the set similarity where shingles repeat
in one text alone, so a text with repeats has a second signature, of its shingles with weight 1,
which agrees with others' in proportion to the sets alone; its bands count as well. Bands of ``BAND`` registers make buckets; whoever shares a
bucket may be a near-duplicate, and texts are linked when the Jaccard similarity of their whole
shingle sets, computed from the texts, is at least the threshold.

Work per bucket is linear where the bucket is one group: members are compared with one of the
bucket first. Buckets that this leaves in several components are compared whole: their
members are cut into blocks by size, each pair of blocks is one task, which counts the shingles
that each member shares with all others at once and gives the links that join components, never
the pairs. So every pair that shares a bucket is either in one component or compared. Exact
copies are one representative from the start. Groups are never held in one task: hubs and
buckets are cut into chunks.

Defined cases: texts with one to four words are one shingle; null and empty texts and texts
without words are alone in their class; rows with equal ids are one document, which shares the
class of each of its texts. Ties go to the lowest id, which is the class id and the one document
that stays; the class of a document without an id is null. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm import common

WORDS, THRESHOLD = 5, 0.8
#: 16 bands of 4 registers: a pair at set similarity 0.8 shares none of those of weight 1 with chance 0.0002.
REGISTERS, BAND = 64, 4
#: Members compared with one hub in a task; characters of a block of an open bucket.
CHUNK, BLOCK_CHARS = 256, 8 << 20
REMEMBERED = 200_000

_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_hashes: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of all runs of ``words`` words in order, repeats included."""
    found = _WORD.findall((text or "").encode("utf-8", "surrogatepass"))
    if not found:
        return np.zeros(0, np.uint64)
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    for w in set(found):
        if w not in _hashes:
            _hashes[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(words, len(h))):
        out = _mix(out + h[j : j + n] + np.uint64(j + 1))
    return out


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingles(text))


def counted(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles of each text, and how often they stand there."""
    return [np.unique(shingles(t), return_counts=True) for t in texts]


def signatures(texts: list[str | None], registers: int = REGISTERS) -> tuple[np.ndarray, np.ndarray]:
    """One row of registers a text (32-bit marks of the shingle that holds each), and shingle counts."""
    return _signed(counted(texts), registers)


def _signed(parts: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p, _ in parts])
    doc = np.repeat(np.arange(len(parts)), sizes)
    if not len(doc):
        return np.zeros((len(parts), registers), np.uint32), sizes
    element = np.concatenate([p for p, _ in parts])
    weight = 1 + np.log(np.concatenate([c for _, c in parts]))
    first = np.full(len(parts) * registers, np.inf)
    holder = np.zeros(len(parts) * registers, np.uint64)
    time = np.zeros(len(element))
    arrival = 0
    while len(element):
        arrival += 1
        u = _mix(element + np.uint64(arrival * 0x9E3779B97F4A7C15 % 2**64))
        time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weight
        cell = doc * registers + (_mix(u) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, cell, time)
        won = time == first[cell]
        holder[cell[won]] = element[won]
        last = first.reshape(-1, registers).max(1)
        going = time < last[doc]  # later arrivals of the others come too late for every register
        element, weight, doc, time = element[going], weight[going], doc[going], time[going]
    return (_mix(holder) >> np.uint64(32)).astype(np.uint32).reshape(-1, registers), sizes


def band_keys(rows: np.ndarray, band: int = BAND) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = rows.reshape(len(rows), rows.shape[1] // band, band).astype(np.uint64)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(band):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.view(np.int64)


def describe(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, digest of the text and band keys of all texts with words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", 4 << 20):
                texts = part.column("text").to_pylist()
                parts = counted(texts)
                rows, sizes = _signed(parts)
                keep = np.flatnonzero(sizes > 0)
                keys = list(band_keys(rows[keep]))
                again = [k for k, i in enumerate(keep) if parts[i][1].max() > 1]
                if again:
                    plain, _ = _signed([(parts[i][0], np.ones_like(parts[i][1])) for i in keep[again]])
                    for k, own in zip(again, band_keys(plain), strict=True):
                        keys[k] = np.union1d(keys[k], own)
                ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
                digests = [hashlib.sha256(texts[k].encode("utf-8", "surrogatepass")).digest() for k in keep]
                columns = [part.column("doc_id").take(pa.array(keep)), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "bands"])
        common.give_back()

    return docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(work, "doc_id bigint, digest binary, bands array<bigint>")


def verify(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets are similar enough, with ``similarity``.

    Members of a hub are dealt out in chunks; a chunk's task holds the hub's set and one member's at a time.
    """
    sized = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = common.join_apart(pairs, sized, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int")).select("a", "chunk", "b")
    hubs = sized.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("a", "chunk", F.col("a").alias("b"))
    rows = dealt.unionByName(hubs).join(texts, F.col("b") == F.col("rep")).select("a", "chunk", "b", "text")
    rows = rows.repartition(common.partitions_for(pairs), "a", "chunk").sortWithinPartitions("a", "chunk", F.col("a") != F.col("b"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = held = None
        for batch in batches:
            a, b, s = [], [], []
            for x, y, t in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text")), strict=True):
                own = shingle_set(t)
                if x == y:
                    hub, held = x, own
                    continue
                if hub != x:
                    raise ValueError("a hub's text is missing")
                both = len(np.intersect1d(held, own, assume_unique=True))
                similarity = both / (len(held) + len(own) - both)
                if similarity >= threshold:
                    a.append(x)
                    b.append(y)
                    s.append(similarity)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "similarity"])
        common.give_back()

    return rows.mapInArrow(work, "a bigint, b bigint, similarity double")


def _block_links(open_members: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between different components of a bucket, compared whole, block by block; those that span them."""
    counts = open_members.groupBy("key").agg(F.ceil(F.sum(F.length("text") + 1) / BLOCK_CHARS).cast("int").alias("blocks"))
    rows = common.join_apart(open_members, counts, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "own", "rep", "component", "text")

    def work(table: pa.Table) -> pa.Table:
        own, rep, component = (table.column(c).to_numpy() for c in ("own", "rep", "component"))
        found = [shingle_set(t) for t in table.column("text").to_pylist()]
        sizes = np.array([len(f) for f in found])
        _, number = np.unique(np.concatenate(found), return_inverse=True)
        ends = np.cumsum(sizes)
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        x, y = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        of_y = np.concatenate([number[ends[j] - sizes[j] : ends[j]] for j in y]) if len(y) else np.zeros(0, np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes[y])[:-1]])
        flag = np.zeros(int(number.max()) + 1, np.int32)
        parent = {int(c): int(c) for c in component}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        a, b = [], []
        for i in x if len(y) else ():
            mine = number[ends[i] - sizes[i] : ends[i]]
            flag[mine] = 1
            both = np.add.reduceat(flag[of_y], starts)
            flag[mine] = 0
            for j in y[(both >= threshold * (sizes[i] + sizes[y] - both)) & (component[y] != component[i])]:
                p, q = root(int(component[i])), root(int(component[j]))
                if p != q:
                    parent[p] = q
                    a.append(int(rep[i]))
                    b.append(int(rep[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("key", "lo", "hi").applyInArrow(work, "a bigint, b bigint")


def classes(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id (the lowest id of its class) of every document, as its rows stand."""
    described = common.materialize(describe(docs, text).withColumn("node", F.xxhash64("digest")), "minhash")
    # Different texts are the vertices. Where every row has an id of its own they are numbered by their
    # lowest ids, which lead back to their texts; else by their digests. Classes are the same.
    repeats = _repeats(docs)
    reps = described.groupBy("node").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    reps = common.materialize(reps.withColumn("rep", F.col("node" if repeats else "id")), "minhash-reps")
    members = reps.select("rep", F.explode("bands").alias("key"))
    hubs = members.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    shared = common.materialize(common.join_apart(members, hubs, "key"), "minhash-shared")  # buckets of two members or more
    pairs = common.materialize(shared.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "minhash-pairs")
    ends = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep")))
    wanted = ends.distinct()
    raw = F.coalesce(F.col(text), F.lit(""))
    if repeats:
        wanted = wanted.join(reps.select("rep", F.col("id").alias("__id")), "rep")
        held = docs.select(F.col("doc_id").alias("__doc"), F.xxhash64(F.unhex(F.sha2(raw.cast("binary"), 256))).alias("rep"), raw.alias("text"))
        held, _ = common.sifted(held, "rep", ends)
        held = held.join(wanted, (held.rep == wanted.rep) & F.col("__doc").eqNullSafe(F.col("__id")), "left_semi").groupBy("rep").agg(F.max("text").alias("text"))
    else:
        held, _ = common.sifted(docs.select(F.col("doc_id").alias("rep"), raw.alias("text")), "rep", ends)
        held = held.join(wanted, "rep", "left_semi")
    held = common.materialize(held, "minhash-texts")
    spent = [reps, shared, pairs, held]
    edges = verify(pairs, held, threshold).select("a", "b")
    if repeats:  # texts of one id are one document
        first = described.groupBy("doc_id").agg(F.min("node").alias("a"))
        edges = edges.unionByName(described.select("doc_id", F.col("node").alias("b")).join(first, "doc_id").where("a <> b").select("a", "b").distinct())
    edges = common.materialize(edges, "minhash-edges")
    components = common.connected_components(edges)
    spent += [edges, components]
    near = shared.join(components, shared.rep == components.node, "left")
    near = common.materialize(near.select("key", "rep", F.coalesce("component", "rep").alias("component")), "minhash-near")
    still = near.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"))
    still = still.where("lo <> hi and n > 2").select("key")  # of two members the one pair is verified already
    new = common.materialize(_block_links(common.join_apart(near, still, "key").join(held, "rep"), threshold), "minhash-edges")
    spent += [near, new]
    if new.limit(1).count():
        components = common.connected_components(edges.unionByName(new))
        spent.append(components)
    of_node = common.materialize(reps.select("node", "rep", "id").join(components, reps.rep == components.node, "left").select(reps.node, "id", "component"), "minhash-classes")
    for table in spent:
        common.release(table)
    common.rest(docs.sparkSession)
    if repeats:
        lowest = of_node.where("component is not null").groupBy("component").agg(F.min("id").alias("lowest"))
        of_node = of_node.join(lowest, "component", "left").withColumn("component", F.col("lowest"))
    of_node = of_node.select("node", F.coalesce("component", "id").alias("class_id"))
    found = described.select("doc_id", "node").join(of_node, "node").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def _repeats(docs: DataFrame) -> bool:
    """Whether an id stands on several rows, or a row has none."""
    return docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count() > 0


def op3_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, class_id and kept of every document; near-duplicates share the class of the lowest id."""
    found = classes(common.documents(spark, sf_dir))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
