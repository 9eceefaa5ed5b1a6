"""Operators against plain Python run from left to right: rows x partitions x order, ties, nulls, stops and errors."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from weirflow.operators.mutate import par_drain, update_where
from weirflow.operators.pipe import Maybe
from weirflow.operators.recursive import TooDeep, linearize, par_rec_edges
from weirflow.plans import order as plan_order
from weirflow.sources import par, par_empty, par_iter, par_range
from weirflow.streaming import StreamPipe

SIZES, PARTS = (0, 1, 257), (1, 4)


def numbers(spark, values, parts=3):
    """(k, x) in the order of k, scattered over partitions."""
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, x long")
    return par(df.repartition(parts, F.xxhash64("k")), "k", ["x"])


def xs(df, name="x"):
    return [r[name] for r in df.collect()]


def value(df):
    return df.collect()[0][0]


@pytest.mark.parametrize("n", SIZES)
@pytest.mark.parametrize("parts", PARTS)
def test_transforms_keep_order(spark, n, parts):
    data = [(7 * k) % 23 for k in range(n)]
    p = numbers(spark, data, parts)
    assert xs(p.collect()) == data
    assert xs(p.map(lambda x: {"x": x.x * 2}).filter(lambda x: x.x > 9).collect()) == [2 * v for v in data if 2 * v > 9]
    assert xs(p.flat_map(lambda x: F.array(x.x, -x.x)).collect(), "value") == [w for v in data for w in (v, -v)]
    assert xs(p.filter_map(lambda x: Maybe(x.x % 2 == 0, {"x": F.when(x.x != 4, x.x)})).collect()) == [None if v == 4 else v for v in data if v % 2 == 0]
    assert [tuple(r) for r in p.enumerate().collect().collect()] == list(enumerate(data))
    assert sorted(xs(p.iteration_order("arbitrary").collect())) == sorted(data)
    assert xs(p.num_threads(1).chunk_size(3).copied().cloned().collect()) == data
    assert xs(p.chain(numbers(spark, [5, 6])).collect()) == data + [5, 6]
    assert xs(p.collect_into(numbers(spark, [5, 6])).collect()) == [5, 6] + data


@pytest.mark.parametrize("n", SIZES)
def test_reductions(spark, n):
    data = [(7 * k) % 23 for k in range(n)]
    p = numbers(spark, data)
    assert value(p.sum("x")) == sum(data) and value(p.count()) == n
    assert value(p.min("x")) == min(data, default=None) and value(p.max("x")) == max(data, default=None)
    assert value(p.all(lambda x: x.x < 22)) == all(v < 22 for v in data)
    assert value(p.any(lambda x: x.x == 22)) == any(v == 22 for v in data)
    assert value(p.first()) == (data[0] if n else None)
    assert value(p.find(lambda x: x.x > 20)) == next((v for v in data if v > 20), None)
    joined = p.map(lambda x: x.x.cast("string")).reduce(lambda a, b: F.concat(a, F.lit(","), b))
    assert value(joined) == (",".join(map(str, data)) if n else None)


def test_folds_over_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(plan_order, "FAN_IN", 5)
    data = [(7 * k) % 101 for k in range(180)]
    p = numbers(spark, data).map(lambda x: x.x.cast("string"))
    assert value(p.reduce(lambda a, b: F.concat(a, b))) == "".join(map(str, data))
    q = numbers(spark, data)
    assert value(q.reduce(lambda a, b: F.greatest(a, b), "x", commutative=True)) == max(data)
    df = par(spark.createDataFrame([(k, v % 10, k) for k, v in enumerate(data)], "k long, x long, id long"), "k", ["x", "id"])
    assert tuple(df.max_by(lambda a, b: a.x - b.x).first()) == max(((v % 10, -k, k) for k, v in enumerate(data)))[::2]
    assert df.min_by(lambda a, b: a.x - b.x).first()["id"] == min((v % 10, k) for k, v in enumerate(data))[1]


def test_ties_and_nulls(spark):
    df = par(spark.createDataFrame([(0, 5), (1, None), (2, 9), (3, 5), (4, 9)], "k long, x long"), "k", ["k", "x"])
    assert df.max_by_key(lambda i: i.x).first()["k"] == 2 and df.min_by_key(lambda i: i.x).first()["k"] == 1
    assert value(df.all(lambda i: i.x > 0)) is False and value(df.any(lambda i: i.x > 100)) is False
    assert xs(df.filter(lambda i: i.x > 5).collect(), "k") == [2, 4]
    assert xs(df.take_while(lambda i: i.x > 0).collect(), "k") == [0]
    assert xs(df.map_while(lambda i: Maybe(i.k < 3, {"x": i.x})).collect()) == [5, None, 9]
    assert value(df.sum("x")) == 28


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-5, 5), max_size=30), st.integers(-5, 5), st.integers(1, 3))
def test_stop_inside_expansion(spark, data, bound, width):
    p = numbers(spark, data).flat_map(lambda x: F.array(*(x.x + j for j in range(width)))).take_while(lambda x: x.value != bound)
    want = []
    for w in (v + j for v in data for j in range(width)):
        if w == bound:
            break
        want.append(w)
    assert xs(p.collect(), "value") == want
    assert value(p.sum()) == sum(want)
    assert xs(p.take_while(lambda x: x.value < 3).collect(), "value") == next((want[:k] for k, v in enumerate(want) if v >= 3), want)


def fallible(spark, data, bad):
    return numbers(spark, data).into_fallible_result(lambda x: {"x": x.x}, lambda x: F.when(x.x.isin(*bad) if bad else F.lit(False), F.concat(F.lit("bad"), x.x.cast("string"))))


def test_fallible(spark):
    data = list(range(20))
    good, bad = fallible(spark, data, []), fallible(spark, data, [13, 7])
    assert xs(good.map(lambda x: {"x": x.x + 1}).collect()) == [v + 1 for v in data] and xs(bad.collect()) == []
    assert value(good.error()) is None and value(bad.error()) == "bad7"
    assert tuple(bad.sum("x").first()) == (None, "bad7") and tuple(good.sum("x").first()) == (190, None)
    assert tuple(good.count().first()) == (20, None) and tuple(bad.count().first()) == (None, "bad7")
    assert tuple(bad.find(lambda x: x.x > 4).first()) == (5, None) and tuple(bad.find(lambda x: x.x > 8).first()) == (None, "bad7")
    assert tuple(bad.any(lambda x: x.x == 3).first()) == (True, None) and tuple(bad.any(lambda x: x.x == 9).first()) == (None, "bad7")
    assert tuple(bad.all(lambda x: x.x < 3).first()) == (False, None) and tuple(bad.all(lambda x: x.x < 99).first()) == (None, "bad7")
    assert tuple(bad.first().first()) == (0, None)
    assert tuple(bad.filter(lambda x: x.x != 7).error().first()) == ("bad7",)
    assert tuple(good.max_by_key(lambda x: x.x % 7).first()) == (6, None) and tuple(good.min_by(lambda a, b: b.x - a.x).first()) == (19, None)
    assert tuple(good.reduce(lambda a, b: a + b, "x", commutative=True).first()) == (190, None)
    assert xs(good.flat_map(lambda x: F.array(x.x, x.x)).collect(), "value") == [v for v in data for _ in "ab"]
    assert xs(good.filter_map(lambda x: Maybe(x.x > 17, {"y": x.x})).collect(), "y") == [18, 19]
    assert tuple(bad.flat_map(lambda x: F.array(x.x)).error().first()) == ("bad7",)
    assert good.collect_into(spark.createDataFrame([(99,)], "x long")).count() == 21


def test_option(spark):
    p = numbers(spark, range(10))
    some = p.into_fallible_option(lambda x: Maybe(x.x < 99, {"x": x.x}))
    none = p.into_fallible_option(lambda x: Maybe(x.x != 6, {"x": x.x}))
    assert tuple(some.sum("x").first()) == (45, False) and tuple(none.sum("x").first()) == (None, True)
    assert tuple(none.first().first()) == (0, False) and tuple(none.find(lambda x: x.x > 7).first()) == (None, True)
    assert xs(none.collect()) == [] and xs(some.collect()) == list(range(10))


def test_state_and_python_closures(spark):
    p = numbers(spark, range(50), 4)
    seen = p.using(lambda k: {"n": 0}).map(lambda s, x: (s.update(n=s["n"] + 1), {"x": x, "n": s["n"]})[1]).filter(lambda s, x, n: x % 2 == 0).into("x long, n long")
    rows = seen.collect().collect()
    assert [r["x"] for r in rows] == list(range(0, 50, 2)) and max(r["n"] for r in rows) <= 50
    copies = p.using_clone([1]).flat_map(lambda s, x: [{"x": x}] * len(s)).inspect(lambda s, x: s.append(1) if len(s) < 2 else None).into("x long")
    assert value(copies.count()) >= 50
    assert xs(p.map_py(lambda x: x + 1, "y long").collect(), "y") == list(range(1, 51))
    assert xs(p.flat_map_py(lambda x: [x] * (x % 3), "y long").collect(), "y") == [x for x in range(50) for _ in range(x % 3)]
    assert xs(p.filter_py(lambda x: x > 47).collect()) == [48, 49]


def test_recursion(spark):
    edges = spark.createDataFrame([(p, c) for p in range(1, 64) for c in (2 * p, 2 * p + 1)], "parent long, child long")
    roots = spark.createDataFrame([(1,)], "node long")
    tree = par_rec_edges(roots, edges)
    assert sorted(xs(tree.collect(), "node")) == list(range(1, 128)) and value(linearize(tree).max("depth")) == 6
    assert value(par_rec_edges(roots, edges, prune=lambda p, c: c % 2 == 0).count()) == 7
    with pytest.raises(TooDeep):
        par_rec_edges(roots, spark.createDataFrame([(1, 2), (2, 1)], "parent long, child long"), most_levels=5)


def test_mutation_and_drain(spark):
    data = list(range(70, 0, -1))
    p = numbers(spark, data)
    assert xs(update_where(p, lambda x: x.x % 3 == 0, lambda x: {"x": -x.x}).collect()) == [-v if v % 3 == 0 else v for v in data]
    taken, rest = par_drain(p, 10, 25)
    assert xs(taken.collect()) == data[10:25] and xs(rest.collect()) == data[:10] + data[25:]
    assert xs(par_drain(p, 60, 999)[0].collect()) == data[60:]
    with pytest.raises(ValueError):
        par_drain(p, 3, 2)


def test_sources_and_observation(spark):
    assert xs(par_range(spark, 5, 1, -1).collect(), "value") == [5, 4, 3, 2]
    assert xs(par_iter(spark, (k * k for k in range(25)), "x long", batch=10).collect()) == [k * k for k in range(25)]
    assert xs(par_iter(spark, iter(()), "x long").collect()) == [] and value(par_empty(spark, "x long").count()) == 0
    seen = Observation("seen")
    assert numbers(spark, range(9)).inspect(seen, n=F.count(F.lit(1))).to_df().count() == 9
    assert numbers(spark, range(9)).diagnostics().agg(F.sum("rows")).first()[0] == 9


def test_stream(spark, tmp_path):
    spark.range(20).withColumnRenamed("id", "x").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("x long").parquet(f"{tmp_path}/in")
    pipe = StreamPipe.over(stream, ["x"]).filter(lambda i: i.x % 2 == 0).flat_map(lambda i: F.array(i.x, i.x + 100))
    q = pipe.to_df().writeStream.format("memory").queryName("streamed").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(xs(spark.table("streamed"), "value")) == sorted(v for k in range(0, 20, 2) for v in (k, k + 100))
    with pytest.raises(AttributeError):
        pipe.take_while
    with pytest.raises(ValueError):
        StreamPipe.over(spark.range(3), ["id"])


def test_plans(spark, tmp_path):
    spark.range(100).selectExpr("id AS k", "id * 2 AS x", "'t' AS unused").write.parquet(f"{tmp_path}/t")
    p = par(spark.read.parquet(f"{tmp_path}/t"), "k").filter(lambda i: i.x > 50).map(lambda i: {"x": i.x + 1}).map(lambda i: {"x": i.x * 2})
    plan = p.to_df()._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(x), GreaterThan(x,50)]" in plan and "ReadSchema: struct<x:bigint>" in plan
    assert "Exchange" not in plan and plan.count("Project") <= 2
