import random

import pytest

from weirflow.llm import common


@pytest.fixture
def skewed(spark):
    """Joins as at scale: nothing is broadcast, and partitions of a few KB are already large."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_hot_key_is_split(skewed):
    rows = skewed.range(0, 40000, 1, 8).selectExpr("if(id % 3 = 0, 7, id) u", "id v")
    low = rows.groupBy("u").agg({"v": "min"}).withColumnRenamed("min(v)", "m")
    joined = common.join_apart(rows, low, "u")
    assert joined.columns == ["u", "v", "m"]
    got = joined.collect()
    least = {}
    for u, v, _ in got:
        least[u] = min(v, least.get(u, v))
    assert len(got) == 40000 and all(r["m"] == least[r["u"]] for r in got)
    assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()


def test_components_with_a_hub(skewed):
    r = random.Random(5)
    edges = [(0, k) for k in range(1, 1500)] + [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(250)] + [(3000 + k, 3001 + k) for k in range(40)]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in common.connected_components(skewed.createDataFrame(edges, "a bigint, b bigint")).collect()}
    loops = {a for a, b in edges if a == b} - {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: root(n) for n in parent if n not in loops}


def test_sifted_loses_no_key(spark, monkeypatch):
    rows = spark.range(-3000, 3000).selectExpr("id k", "'t' t").unionByName(spark.createDataFrame([(None, "n")], "k bigint, t string"))
    keys = spark.range(0, 3000, 10).selectExpr("id z").unionByName(spark.createDataFrame([(None,), (10,)], "z bigint"))
    for most in (common.MOST_ROWS, 1):
        monkeypatch.setattr(common, "MOST_ROWS", most)
        monkeypatch.setattr(common, "BITS", 16 if most > 1 else 1)
        some, others = ([r["k"] for r in part.collect()] for part in common.sifted(rows, "k", keys))
        assert set(range(0, 3000, 10)) <= set(some) and None in others
        assert sorted(some + [k for k in others if k is not None]) == list(range(-3000, 3000))
        assert len(some) < 1200
    some, others = common.sifted(rows, "k", keys.where("z < 0"))
    assert some.count() == 0 and others.count() == 6001
