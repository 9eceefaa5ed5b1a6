"""Knobs that are observed, and pipelines with state against plain Python."""

import pytest
from pyspark.sql import functions as F

from weirflow.operators.params import BOUND
from weirflow.operators.recursive import OtherLength, par_rec_exact
from weirflow.plans import order
from weirflow.sources import par, par_range


def test_bound_from_the_environment(spark, monkeypatch):
    monkeypatch.setenv(BOUND, "2")
    assert par_range(spark, 0, 1000).diagnostics().count() <= 2
    monkeypatch.setenv(BOUND, "many")
    with pytest.raises(ValueError):
        par_range(spark, 0, 10)


def test_chunks_reach_closures(spark):
    told = par(spark.range(0, 50, 1, 2), "id").chunk_size(8).diagnostics().collect()
    assert sum(r["rows"] for r in told) == 50 and max(r["largest_batch"] for r in told) == 8 and sum(r["calls"] for r in told) == 8
    assert par(spark.range(50), "id").chunk_size(7).map_py(lambda id: id * 2, "v long").sum().first()[0] == 2450  # noqa: A006


def test_runner_keeps_columns(spark):
    pipe = par(spark.range(9), "id")
    assert pipe.with_runner(lambda df: df.repartition(2)).count().first()[0] == 9
    with pytest.raises(ValueError):
        pipe.with_runner(lambda df: df.select("id"))


def test_exact_length(spark):
    roots = spark.createDataFrame([(1,)], "v long")
    extend = lambda level: level.where("v < 8").select((F.col("v") * 2).alias("v"))
    assert [r["v"] for r in par_rec_exact(roots, extend, 4).collect().collect()] == [1, 2, 4, 8]
    with pytest.raises(OtherLength):
        par_rec_exact(roots, extend, 5)


def test_folds_start_within_tasks(spark, monkeypatch):
    monkeypatch.setattr(order, "FAN_IN", 7)
    pipe = par(spark.range(0, 500, 1, 6), "id").map(lambda x: {"v": x.id.cast("string")})
    assert pipe.reduce(lambda a, b: F.concat(a, F.lit(","), b)).first()[0] == ",".join(map(str, range(500)))
    assert par(spark.range(500), "id").reduce(lambda a, b: F.greatest(a, b), commutative=True).first()[0] == 499
    assert par(spark.range(0), "id").reduce(lambda a, b: a + b).first()[0] is None


def test_positions_beyond_five_digits(spark, tmp_path):
    names = sorted([f"part-{k:05d}-x.parquet" for k in (0, 99_999, 100_000, 100_001)], key=lambda n: int(n.split("-")[1]))
    assert names != sorted(names)
    df = spark.createDataFrame([(n,) for n in names], "f string")
    got = [r["f"] for r in df.orderBy(F.regexp_extract("f", r"part-(\d+)", 1).cast("long")).collect()]
    assert got == names


def test_reduce_with_state(spark):
    pipe = par(spark.range(0, 200, 1, 5), "id").using(lambda k: {"seen": 0})

    def add(state, a, b):
        state["seen"] += 1
        assert state["seen"] <= 200
        return {"v": a["v"] + b["v"]}

    assert pipe.map(lambda s, id: {"v": f"{id};"}).reduce(add, "v string").first()[0] == "".join(f"{k};" for k in range(200))  # noqa: A006
    assert pipe.filter(lambda s, id: False).reduce(add, "id long").first()[0] is None  # noqa: A006
