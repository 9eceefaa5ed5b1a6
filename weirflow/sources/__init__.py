"""Where pipelines begin."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.operators.pipe import Pipe


def par(df: DataFrame, key: list[str] | str, items: list[str] | None = None) -> Pipe:
    """Rows of a DataFrame in the order of a unique key."""
    return Pipe.over(df, [key] if isinstance(key, str) else key, items)


def read_par(spark: SparkSession, path: str, key: list[str] | str, items: list[str] | None = None, form: str = "parquet", **options) -> Pipe:
    return par(spark.read.format(form).options(**options).load(path), key, items)


def par_range(spark: SparkSession, begin: int, end: int, step: int = 1) -> Pipe:
    """Integers, as the column ``value``."""
    df = spark.range(begin, end, step).withColumnRenamed("id", "value")
    return Pipe.over(df.withColumn("__at", F.col("value") * (1 if step > 0 else -1)), ["__at"], ["value"])


def par_iter(spark: SparkSession, iterable: Iterable, schema: str, batch: int = 100_000) -> Pipe:
    """Any finite Python iterable of tuples, pulled on the driver in batches that become one table."""
    from itertools import islice

    from pyspark.sql.types import StructField, StructType, LongType

    from weirflow.plans.shared import new_path

    fields = StructType.fromDDL(schema)
    indexed = StructType([StructField("__at", LongType()), *fields.fields])
    path, source, at = new_path(spark, "iterable"), iter(iterable), 0
    while True:
        rows = [(at + k, *(x if isinstance(x, tuple) else (x,))) for k, x in enumerate(islice(source, batch))]
        if rows or not at:
            spark.createDataFrame(rows, indexed).write.mode("append").parquet(path)
        at += len(rows)
        if len(rows) < batch:
            break
    return Pipe.over(spark.read.schema(indexed).parquet(path), ["__at"], fields.names)


def par_empty(spark: SparkSession, schema: str) -> Pipe:
    df = spark.createDataFrame([], schema)
    return Pipe.over(df, df.columns)
