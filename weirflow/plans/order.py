"""Order keys, dense indexes and ordered folds.

Rows have no order in Spark, so a pipeline carries one struct column, ``ORD``, that compares
like the position of its rows. It must be unique; operators that make several rows of one
extend it by the place among them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.plans.shared import new_path, written

ORD = "__ord"
#: Rows that one step of a fold reduces to one.
FAN_IN = 4096


def key_of(columns: list[str]) -> Column:
    return F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(columns))).alias(ORD)


def extended(place: Column) -> Column:
    """The key of a row that came from a row with the present key, ``place`` among its siblings."""
    return F.struct(F.col(ORD).alias("of"), place.alias("at"))


def dense_index(df: DataFrame, name: str = "index") -> DataFrame:
    """``df`` with its 0-based position by ``ORD``, without a task that sees all rows.

    Rows are range-partitioned, sorted and written; a row's index is its place in its file plus
    the rows of the files before it. Files do not change, so a repeated task finds the same places.
    """
    spark = df.sparkSession
    path = new_path(spark, "index")
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    df.repartitionByRange(n, ORD).sortWithinPartitions(ORD).write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    # A file is named by its partition's number, whose digits grow beyond five; one row a file.
    files = rows.groupBy("__file").agg(F.count("*").alias("__n"))
    number = F.regexp_extract("__file", r"part-(\d+)", 1).cast("long")
    before = F.coalesce(F.sum("__n").over(Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.withColumn("__before", before).drop("__n")
    return rows.join(files, "__file").withColumn(name, (F.col("__before") + F.col("__row")).cast("long")).drop("__file", "__row", "__before")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch as one row with an array, at most ``FAN_IN`` of them; nothing is copied."""
    for batch in batches:
        for at in range(0, batch.num_rows, FAN_IN):
            part = batch.slice(at, FAN_IN)
            rows = pa.StructArray.from_arrays(part.columns, names=["o", "value"])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), rows)], names=["xs"])


def tree_fold(df: DataFrame, item: Column, combine: Callable[[Column, Column], Column], ordered: bool) -> DataFrame:
    """One row with the column ``value``: all items combined, NULL for none.

    ``ordered``: ``combine`` is associative only, so neighbours are combined, in order, after a
    range sort; else it is commutative too, and no row moves. Each task first folds its rows, some
    ``FAN_IN`` at a time; the results are folded in rounds of at most ``FAN_IN`` a task's array.
    """
    rows = df.select(F.col(ORD).alias("o"), item.alias("value"))
    if ordered:
        rows = rows.repartitionByRange("o").sortWithinPartitions("o")
    o, value = (rows.schema[c].dataType.simpleString() for c in ("o", "value"))

    def folded(xs: str) -> Column:
        values = F.transform(xs, lambda x: x["value"])
        return F.aggregate(F.slice(values, F.lit(2), F.size(xs)), F.element_at(values, 1), combine).alias("value")

    partial = rows.mapInArrow(_packed, f"xs array<struct<o:{o},value:{value}>>")
    partial = written(partial.select(F.element_at("xs", 1)["o"].alias(ORD), folded("xs")), "fold")
    if ordered:
        rows = dense_index(partial, "at")
        size = (rows.agg(F.max("at")).first()[0] or 0) + 1
    else:
        rows = partial.withColumn("at", F.pmod(F.xxhash64(ORD), F.lit(1 << 40)))
        size = partial.count()
    rows = rows.select("at", F.col(ORD).alias("o"), "value")
    while True:
        buckets = max(1, -(-size // FAN_IN))
        bucket = F.floor(F.col("at") / FAN_IN) if ordered else F.pmod("at", F.lit(buckets))
        packed = rows.groupBy(bucket.alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("at", "o", F.struct("value").alias("v")))).alias("xs"))
        packed = packed.withColumn("vs", F.transform("xs", lambda x: F.struct(x["v"]["value"].alias("value"))))
        rows = packed.select(F.col("bucket").alias("at"), F.element_at("xs", 1)["o"].alias("o"), folded("vs"))
        if buckets == 1:
            break
        size = buckets
    return rows.agg(F.first("value").alias("value"))
