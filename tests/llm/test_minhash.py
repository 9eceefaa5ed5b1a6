import random
import re

import numpy as np
import pytest

from tests.llm.helpers import HARD, docs_frame, prose
from weirflow.llm import minhash


def sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(ids, texts):
    s = sets(texts)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if s[a] and s[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.8:
                x, y = root(ids[a]), root(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def corpus():
    r = random.Random(4)
    texts = list(HARD)
    for g in range(12):
        words = prose(150 + 20 * g, 500 + g).split()
        for k in range(r.randrange(1, 9)):
            w = list(words)
            for _ in range(r.randrange(0, 9)):
                w[r.randrange(len(w))] = "edit%d" % r.randrange(99)
            texts.append(" ".join(w))
    chain = prose(200, 900).split()  # each like the one before, the ends unlike each other
    for k in range(20):
        texts.append(" ".join(chain))
        for j in range(2):
            chain[(k * 17 + j * 90) % 200] = f"step{k}x{j}"
    return texts


@pytest.mark.parametrize("block", [8 << 20, 4000])
def test_classes(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_CHARS", block)
    texts = corpus()
    ids = list(range(len(texts)))
    random.Random(3).shuffle(ids)
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs_frame(spark, texts, ids).repartition(3)).collect()}
    assert got == brute(ids, texts)


def test_signature_estimates_similarity():
    a, b = prose(800, 1).split(), prose(800, 1).split()
    for k in range(0, 800, 40):
        b[k] = "other%d" % k
    x, y = sets([" ".join(a), " ".join(b)])
    true = len(x & y) / len(x | y)
    rows, sizes = minhash.signatures([" ".join(a), " ".join(b)], registers=4096)
    assert abs((rows[0] == rows[1]).mean() - true) < 0.05 and sizes.tolist() == [len(x), len(y)]
    one, _ = minhash.signatures([" ".join(a), "alone", None])
    small, _ = minhash.signatures([" ".join(a)])
    assert (one[0] == small[0]).all()


def test_repeated_ids_nulls_and_empty(spark):
    t = prose(50, 1)
    rows = minhash.classes(docs_frame(spark, [t, t, None, "", prose(50, 2)], [3, 3, 5, None, 8])).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["class_id"] or 0) for r in rows) == [(False, 3, 3), (False, 3, 3), (False, 5, 5), (False, 8, 8), (True, 0, 0)]
    assert minhash.classes(docs_frame(spark, [])).count() == 0


def test_repeats_in_the_unshared_part(spark):
    r = random.Random(8)
    texts = []
    for k in range(60):  # pairs at set similarity 0.8 to 0.85; one has 40 shingles more, each about 60 times
        shared = [f"p{k}w{r.randrange(10**6)}" for _ in range(200)]
        texts += [" ".join(shared), " ".join(shared + [f"f{k}x{j}" for j in range(40)] * 60)]
    s = sets(texts)
    similar = [len(s[i] & s[i + 1]) / len(s[i] | s[i + 1]) for i in range(0, len(texts), 2)]
    assert all(0.8 <= x <= 0.85 for x in similar)
    ids = list(range(len(texts)))
    got = {row["doc_id"]: row["class_id"] for row in minhash.classes(docs_frame(spark, texts, ids)).collect()}
    assert got == {k: k - k % 2 for k in ids}
