import hashlib
import random

import numpy as np
import pytest

from tests.llm.helpers import HARD, docs_frame, prose
from weirflow.llm import suffix_dedup as sd


def brute(docs):
    """docs: (id, text) in the order that decides who is earlier."""
    seen, out = set(), []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        runs = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def corpus():
    r = random.Random(2)
    passage, other = prose(40, 77), prose(25, 78)
    texts = list(HARD)
    for k in range(60):
        parts = [prose(r.randrange(60), 100 + k)]
        if k % 3 == 0:
            parts.append(passage)
        if k % 4 == 0:
            parts.append(other[r.randrange(20) :])
        if k % 7 == 0:
            parts += [parts[0]] * 2
        r.shuffle(parts)
        texts.append(" ".join(parts))
    near = prose(300, 5).split()
    for k in range(25):
        w = list(near)
        for _ in range(k % 5):
            w[r.randrange(300)] = "changed%d" % r.randrange(9)
        texts.append(" ".join(w))
    texts += ["ab" * 400, "ab" * 300 + "c", "z" * 99, "z" * 100, "z" * 101, "é" * 200]
    return texts


@pytest.mark.parametrize("parts,unit", [(1, 16 << 20), (5, 16 << 20)])
def test_against_brute_force(spark, monkeypatch, parts, unit):
    monkeypatch.setattr(sd, "UNIT", unit)
    texts = corpus()
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    df = docs_frame(spark, texts, ids).repartition(parts)
    got = {r["doc_id"]: r for r in sd.remove_repeats(df).collect()}
    for i, n, removed, runs, kept in brute(sorted(zip(ids, texts))):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (n, removed, runs, kept), i
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_columns_sort_suffixes():
    r = np.random.default_rng(0)
    text = r.integers(97, 99, (60, 20)).astype(np.uint8)
    group = r.integers(0, 4, 60)
    for j, order, prefixes in sd.columns(text, group):
        keys = [(group[i], text[i, j:].tobytes()) for i in order]
        assert keys == sorted(keys)
        for k in range(1, 60):
            a, b = keys[k - 1], keys[k]
            same = 0
            while a[0] == b[0] and same < len(a[1]) and a[1][same] == b[1][same]:
                same += 1
            assert prefixes[k] == same


def test_column_files_are_written_once(tmp_path):
    r = np.random.default_rng(1)
    text = r.integers(97, 99, (60, 20)).astype(np.uint8)
    group = r.integers(0, 4, 60)
    before = set()
    for (j, order, prefixes), plain in zip(sd.columns(text, group, f"file://{tmp_path}"), sd.columns(text, group), strict=True):
        assert j == plain[0] and (order == plain[1]).all() and (prefixes == plain[2]).all()
        names = {p.name for p in tmp_path.glob("*/*")} - {"symbols"}
        assert names and not names & before  # a file that is written over is flushed to disk
        assert sum(p.stat().st_size for p in tmp_path.glob("*/*")) <= text.size + 6 * len(group)
        before = names
    assert not list(tmp_path.iterdir())


def test_repeated_rows_and_empty(spark):
    t = prose(80, 9)
    rows = sd.remove_repeats(docs_frame(spark, [t, t, t], [4, 4, None])).collect()
    assert len(rows) == 3 and sorted(r["n_removed"] > 0 for r in rows) == [False, True, True]
    assert sd.remove_repeats(docs_frame(spark, [])).count() == 0
