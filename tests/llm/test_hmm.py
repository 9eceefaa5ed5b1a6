import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import HARD, docs_frame, prose
from weirflow.llm import hmm


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]


def test_base_scores(spark, monkeypatch):
    monkeypatch.setattr(hmm, "CHUNK", 20000)
    other = lambda t: t.translate(str.maketrans("aeiou", "äéîöü"))  # noqa: E731  a second language
    texts = HARD + [(other if k % 2 else str)(prose(150, k)) + " Über KK" for k in range(120)]
    df = docs_frame(spark, texts).repartition(3)
    got = {r["doc_id"]: r for r in hmm.score(*hmm.fit(df)).collect()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))}
    c = Counter(w for k, t in enumerate(texts) if not held[k] for w in words(t))
    n, v = sum(c.values()), len(c)
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        r, w = got[k], words(t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert r["score"] <= 0
    assert sum(r["score"] for k, r in got.items() if held[k]) > sum(r["base_score"] for k, r in got.items() if held[k])


def test_forward_and_expectations_are_exact():
    rng = np.random.default_rng(0)
    k, s = 3, 4
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(s), k).T)
    lengths = np.array([3, 1, 5, 4], np.int32)
    symbols = rng.integers(0, s, lengths.sum()).astype(np.int32)
    starts, moves, emissions, logs = np.zeros(k), np.zeros((k, k)), np.zeros((s, k)), []
    at = 0
    for n in lengths:
        doc, total, found = symbols[at : at + n], 0.0, []
        at += n
        for path in itertools.product(range(k), repeat=int(n)):
            p = model.start[path[0]] * model.emissions[doc[0], path[0]]
            for a, b, x in zip(path, path[1:], doc[1:]):
                p *= model.moves[a, b] * model.emissions[x, b]
            total += p
            found.append((path, p))
        logs.append(math.log10(total))
        for path, p in found:
            starts[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / total
            for x, a in zip(doc, path):
                emissions[x, a] += p / total
    assert hmm.forward(model, lengths, symbols) == pytest.approx(logs)
    s_, m_, at_, e_, log = hmm.expected(model, lengths, symbols)
    full = np.zeros((s, k))
    full[at_] = e_
    assert s_ == pytest.approx(starts) and m_ == pytest.approx(moves) and full == pytest.approx(emissions) and log == pytest.approx(sum(logs))


def test_rounds_do_not_lose_likelihood(spark):
    df = docs_frame(spark, [prose(80, k % 9) for k in range(80)])
    coded, model, corpus = hmm.fit(df, rounds=0)
    seen = []
    for _ in range(3):
        model, log = hmm.baum_welch(coded, model, corpus)
        seen.append(log)
    assert seen[0] <= seen[1] + 1 and seen[1] <= seen[2] + 1
    assert model.emissions.sum(0) == pytest.approx(1) and model.moves.sum(1) == pytest.approx(1)


def test_corner_tables(spark):
    assert hmm.score(*hmm.fit(docs_frame(spark, []))).count() == 0
    only_held = [k for k in range(40) if zlib.crc32(str(k).encode()) % 7 == 2][:3]
    rows = hmm.score(*hmm.fit(docs_frame(spark, ["a b", None, ""], only_held))).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in rows)
    rows = hmm.score(*hmm.fit(docs_frame(spark, ["a b", "a b", "c"], [1, 1, None]))).collect()
    assert len(rows) == 3


def test_all_rounds_see_the_corpus_until_it_settles(spark, monkeypatch):
    monkeypatch.setattr(hmm, "CHUNK", 6000)
    other = lambda t: t.translate(str.maketrans("aeiou", "äéîöü"))  # noqa: E731  the first chunks hold one language only
    df = docs_frame(spark, [(other if k >= 60 else str)(prose(100, k)) for k in range(120)])
    found = []
    for order in ("doc_id", "lang"):
        rows = df.select("doc_id", "text", (-df.doc_id).alias("lang")).coalesce(1).sortWithinPartitions(order)
        coded, model, corpus = hmm.fit(rows)
        model_after, log = hmm.baum_welch(coded, model, corpus)
        assert hmm.baum_welch(coded, model_after, corpus)[1] - log <= 1e-4 * abs(log)
        found.append({r["doc_id"]: r["score"] for r in hmm.score(coded, model, corpus).collect()})
    # The layout of the input chooses nothing.
    assert found[0] == pytest.approx(found[1], rel=1e-3)
