"""Pieces that several operators of this subpackage share.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``; it is shared by
the driver and all executors, so a lost executor loses none of them.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words everywhere in the contracts: space and the ASCII controls 9 to 13.
SPACE_BYTES = "\x20\x09-\x0d"
WORD_REGEX = r"[^\x20\x09-\x0D]+"
#: Bits of one row of a bitmap (Spark's ``bitmap_construct_agg``), bits for each key, and most rows.
BITMAP, BITS, MOST_ROWS = 8 * 4096, 16, 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset (tests), a temporary one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="weirflow-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/weirflow/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weirflow_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files behind a frame of ``materialize`` that nothing reads any more."""
    drop_path(df.sparkSession, df._weirflow_path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions_for(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions the session asks for."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def give_back() -> None:
    """Memory that a worker has freed goes back to the system, as the worker lives on for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def rest(spark: SparkSession) -> None:
    """Between queries the driver drops the plans that ended, and its heap shrinks to what is in use."""
    give_back()
    spark.sparkContext._jvm.System.gc()


def slices(batch: pa.RecordBatch, column: str | int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch whose ``column`` holds about ``most`` bytes each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def join_apart(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """``rows.join(other, key)`` whose sides are both shuffled for the join, so adaptive execution can split a hot key's rows.

    ``other`` is mostly an aggregate by ``key``; a join takes over such a partitioning, and its partitions
    are never split. A second join key, the hash of the first, asks for shuffles of their own.
    """
    hashed = F.xxhash64(key)
    return rows.withColumn("__hash", hashed).join(other.withColumn("__hash", hashed), ["__hash", key]).drop("__hash")


def sifted(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose bigint ``key`` may be among the one column of ``keys``, and those where it is surely not, as a null is.

    A bitmap of the keys' hashes tells, so only the first need a join, and the others' texts are not shuffled
    however many keys there are. It has ``BITS`` bits a key and 16 MB at most; beyond that more rows may match.
    """
    n = min(MOST_ROWS, -(-keys.count() * BITS // BITMAP) or 1)
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("bigint")), F.lit(n * BITMAP))
    part = lambda c: F.floor(place(c) / BITMAP).cast("int")
    own = keys.columns[0]
    bits = keys.select(part(own).alias("__part"), (place(own) % BITMAP).alias("__bit")).groupBy("__part").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    bits = materialize(bits, "bitmap")
    bit = place(key) % BITMAP
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    met = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)) & F.col(key).isNotNull()
    marked = rows.withColumn("__part", part(key)).join(F.broadcast(bits), "__part", "left").withColumn("__met", met)
    return marked.where("__met").select(*rows.columns), marked.where("not __met").select(*rows.columns)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` of an undirected edge table: the smallest node reachable from each.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Every neighbour list is
    reduced to its minimum by a partial aggregate and joined back; shuffles hold at most the edges
    in both directions. A hub's edges are one key of that join, which adaptive execution splits
    where it is large (see ``join_apart``; the other side has one row a node).
    Rounds stop when the edge set repeats; their number is logarithmic in practice.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = materialize(e, "cc")
    state = lambda: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.max("u")).first())
    before = state()
    while True:
        # Large star: each node links its larger neighbours to its smallest neighbour or itself.
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join_apart(both, low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node links its smaller neighbours and itself to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_apart(large, low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = materialize(small.where("u <> v").distinct(), "cc")
        release(e)
        e = after
        now = state()
        if now == before:
            break
        before = now
    rest(spark)
    node = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = node.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._weirflow_path = e._weirflow_path
    return out
