import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import HARD, docs_frame, prose
from weirflow.llm import mixing


def targets(sizes):
    """sizes: source -> words; the contract's resharing, step by step."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        left, w = total - sum(capped.values()), sum(weight[s] for s in order if s not in capped)
        goal = {s: left * weight[s] / w for s in order if s not in capped} if w else {}
        over = [s for s, g in goal.items() if g > 3 * sizes[s] + 1e-9]
        if not over:
            return goal | capped
        capped |= {s: 3 * sizes[s] for s in over}


def corpus(n=400, sources=7):
    r = random.Random(6)
    texts = [prose(r.choice([0, 1, 5, 40, 300]), k) for k in range(n)] + HARD
    names = [r.choice(["big", "big", "big", *(f"s{k}" for k in range(sources)), None, "tiny", "\U0001f600", "é"]) for _ in texts]
    return texts, [s if s != "tiny" or r.random() < 0.1 else "big" for s in names]


def test_mix(spark):
    texts, sources = corpus()
    df = docs_frame(spark, texts, sources=sources)
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    total = Counter()
    for s, n in zip(sources, size):
        total[s] += n
    goal = targets(total)
    rows = {r["doc_id"]: r for r in mixing.mix(df.repartition(4)).collect()}
    assert len(rows) == len(texts)
    taken = Counter()
    for k, r in rows.items():
        assert r["size"] == size[k] and r["source_size"] == total[sources[k]] and r["source"] == sources[k]
        assert r["target"] == pytest.approx(goal[sources[k]])
        assert 0 <= r["taken"] <= 3 * size[k]
        taken[sources[k]] += r["taken"]
    for s, g in goal.items():
        assert abs(taken[s] - g) <= 2 * mixing.BLOCK + 0.01 * g, (s, taken[s], g)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(2)).collect()}
    assert again == {k: r["taken"] for k, r in rows.items()}


def test_plan(spark):
    goal = spark.createDataFrame([(0, 40, 120), (1, 1000, 700), (2, 3, 2), (3, 0, 0)], "place long, blocks long, quota long")
    plan = mixing.draw(goal, shard=64).collect()
    by = {}
    for r in plan:
        by.setdefault(r["place"], []).append(r)
    assert {p: len(v) for p, v in by.items()} == {0: 120, 1: 700, 2: 2}
    for p, v in by.items():
        blocks = {0: 40, 1: 1000, 2: 3}[p]
        assert sorted(r["slot"] for r in v) == list(range(len(v)))
        for epoch in range(-(-len(v) // blocks)):
            mine = [r["block"] for r in v if r["slot"] // blocks == epoch]
            assert len(set(mine)) == len(mine) and all(0 <= b < blocks for b in mine)
    sizes = Counter(r["shard"] for r in plan)
    assert all(n == 64 for s, n in sizes.items() if s < max(sizes))


def test_permutation(spark):
    for n in (1, 2, 3, 7, 16, 17, 100, 257, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("p")).collect()]
        assert sorted(got) == list(range(n))


def test_native_and_empty(spark):
    df = mixing.mix(docs_frame(spark, ["a b", None]))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    assert mixing.mix(docs_frame(spark, [])).count() == 0
    assert mixing.mix(docs_frame(spark, [None, ""])).count() == 2
    assert mixing.mix(docs_frame(spark, ["a b", "a b", "c"], [1, 1, None])).count() == 3


def test_the_last_plan_is_small(spark):
    plan = mixing.mix(docs_frame(spark, [f"a b {k}" for k in range(40)]))._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and plan.count("Exchange") < 20  # the driver holds a plan as often as Spark replans it
