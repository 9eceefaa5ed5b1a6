"""Recall of the pivot index against brute force on tables of several shapes, and the exact way."""

import numpy as np
import pytest

from tests.llm.test_vectors import brute, frame
from weirflow.llm import vectors


def rows_of(x, at=0):
    return [(at + k, v.tolist()) for k, v in enumerate(np.asarray(x, np.float32))]


def with_partners(x, r, share=0.3):
    """Vectors and, for a share of them, a partner at a cosine of 0.95 to 1."""
    some = x[r.random(len(x)) < share]
    aside = r.normal(size=some.shape)
    aside -= (aside * some).sum(1, keepdims=True) / (some * some).sum(1, keepdims=True) * some
    aside *= np.linalg.norm(some, axis=1, keepdims=True) / np.linalg.norm(aside, axis=1, keepdims=True)
    t = r.uniform(0.951, 0.999, (len(some), 1))
    return np.concatenate([x, t * some + np.sqrt(1 - t * t) * aside])


def uniform(r):
    return with_partners(r.normal(size=(900, 32)), r)


def clustered(r):
    centres = r.normal(size=(40, 32))
    return with_partners(np.repeat(centres, 15, 0) + r.normal(size=(600, 32)) * r.uniform(0.1, 0.5, (600, 1)), r)


def anisotropic(r):
    return r.normal(size=(500, 32)) * 0.25 + np.ones(32)


def dense(r):
    return np.concatenate([r.normal(size=(400, 32)), r.normal(size=32) + r.normal(size=(400, 32)) * 0.14])


@pytest.mark.parametrize("shape", [uniform, clustered, anisotropic, dense])
def test_recall(spark, monkeypatch, shape):
    monkeypatch.setattr(vectors, "BLOCK", 100)
    rows = rows_of(shape(np.random.default_rng(5)))
    want = brute(rows)
    true = sum(n for n, _ in want.values())
    df = frame(spark, rows)
    for exact, least in ((False, 0.97), (True, 1.0)):
        got = {x["vec_id"]: x for x in vectors.near_duplicates(df, exact=exact).collect()}
        assert true > 0 and least * true <= sum(x["n_links"] for x in got.values()) <= true
        assert all(got[i]["n_links"] <= n for i, (n, _) in want.items())
        assert sum(got[i]["component_id"] == c for i, (_, c) in want.items()) >= least * len(rows)


def test_two_vectors_and_mixed_lengths(spark):
    r = np.random.default_rng(3)
    near = lambda v: (v + r.normal(size=v.shape) * 0.05).tolist()
    a, b, c = r.normal(size=8), r.normal(size=3), r.normal(size=5)
    rows = [(k, near(v)) for k, v in enumerate([a, a])]
    got = {x["vec_id"]: x for x in vectors.near_duplicates(frame(spark, rows)).collect()}
    assert [(got[k]["n_links"], got[k]["component_id"]) for k in (0, 1)] == [(1, 0), (1, 0)]
    rows = [(k, near(v)) for k, v in enumerate([a, b, c, a, b, c, a, a])]
    want = brute(rows)
    got = {x["vec_id"]: x for x in vectors.near_duplicates(frame(spark, rows)).collect()}
    assert {k: (x["n_links"], x["component_id"]) for k, x in got.items()} == want and want[5] == (1, 2)


def test_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (None, [0.01, 1.0]), (None, [-1.0, 0.0])]
    got = sorted((x["vec_id"] or 0, x["n_links"], x["component_id"], x["kept"]) for x in vectors.near_duplicates(frame(spark, rows)).collect() if x["component_id"] is not None)
    assert got == [(0, 2, 1, False), (1, 0, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
