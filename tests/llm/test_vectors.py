import numpy as np

from weirflow.llm import vectors


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) if x is not None else None for x in v], 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, n_links int")


def brute(rows):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            (i, x), (j, y) = ok[a], ok[b]
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                links[i] += 1
                links[j] += 1
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: (links[i], root(i)) for i, _ in rows}


def test_links_and_components(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    r = np.random.default_rng(1)
    rows, at = [], 0
    for g in range(60):
        centre = r.normal(size=32)
        for _ in range(int(r.integers(1, 8))):
            rows.append((at, list(centre + r.normal(size=32) * 0.12)))
            at += 1
    hot = r.normal(size=32)
    for _ in range(120):
        rows.append((at, list(hot + r.normal(size=32) * 0.1)))
        at += 1
    for _ in range(30):
        rows.append((at, list(hot)))
        at += 1
    bad = [None, [], [0.0] * 32, [float("nan")] * 32, [None] * 32, [float("inf")] + [1.0] * 31, [1.0, 2.0]]
    rows += [(at + k, v) for k, v in enumerate(bad)]
    want = brute(rows)
    got = {x["vec_id"]: x for x in vectors.near_duplicates(frame(spark, rows).repartition(3)).collect()}
    true, found = sum(n for n, _ in want.values()), sum(x["n_links"] for x in got.values())
    assert len(got) == len(rows) and 0.97 * true <= found <= true
    for i, x in got.items():
        assert x["n_links"] <= want[i][0] and x["kept"] == (x["component_id"] == i)
    assert sum(got[i]["component_id"] == want[i][1] for i in want) >= 0.97 * len(rows)
    for k in range(len(bad)):
        assert (got[at + k]["n_links"], got[at + k]["component_id"]) == (0, at + k)


def test_none(spark):
    assert vectors.near_duplicates(frame(spark, [])).count() == 0
    assert [r["n_links"] for r in vectors.near_duplicates(frame(spark, [(1, None), (2, [0.0])])).collect()] == [0, 0]
