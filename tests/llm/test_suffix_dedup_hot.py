"""Texts longer than a piece, groups beyond what is sorted together, anchors that are split, several units."""

import random

import numpy as np
import pytest

from tests.llm.helpers import docs_frame, prose
from tests.llm.test_suffix_dedup import brute, corpus
from weirflow.llm import suffix_dedup as sd


def check(spark, texts, parts):
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    got = {r["doc_id"]: r for r in sd.remove_repeats(docs_frame(spark, texts, ids).repartition(parts)).collect()}
    for i, n, removed, runs, kept in brute(sorted(zip(ids, texts))):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (n, removed, runs, kept), i


@pytest.mark.parametrize("hot,together,piece", [(3, 50, 700), (20, 1000, 1 << 20)])
def test_split_anchors(spark, monkeypatch, hot, together, piece):
    for name, value in (("HOT", hot), ("TOGETHER", together), ("PIECE", piece)):
        monkeypatch.setattr(sd, name, value)
    line = prose(30, 99)
    texts = corpus() + [f"{prose(3, 1000 + k)} {line} {prose(k % 7, 2000 + k)}" for k in range(80)]
    check(spark, texts, 6)


def test_long_texts(spark):
    passage = prose(60, 5)
    long = prose(200_000, 6)
    assert len(long) > sd.PIECE
    check(spark, [long[:600_000] + passage + long[600_000:], prose(20, 7) + passage, long[900_000:1_100_000]], 3)


def test_groups_beyond_what_is_sorted_together(monkeypatch, tmp_path):
    """In this process, as workers read the module's own values."""
    texts = [t.encode() for t in corpus() if t]
    unit, ids = np.zeros(0, np.int64), np.arange(len(texts))
    found = []
    for together, piece, root in ((1 << 15, 1 << 20, None), (20, 500, f"file://{tmp_path}")):
        monkeypatch.setattr(sd, "TOGETHER", together)
        monkeypatch.setattr(sd, "PIECE", piece)
        anchors = sd.repeated(sd.unit_anchors(texts, [r for r, t in enumerate(texts) if len(t) >= 100]))
        strings = sd.strings_of(anchors, texts, ids)
        unit = np.zeros(len(strings), np.int64)
        marks = sd.marks_of(strings, sd.mark_repeats(strings, unit, root))
        found.append({(int(m["row"]), w) for m in marks for w in range(m["first"], m["last"] + 1)})
        split = sd.split_by_context(strings)
        marks = sd.marks_of(split, sd.mark_repeats(split, np.zeros(len(split), np.int64), root))
        found.append({(int(m["row"]), w) for m in marks for w in range(m["first"], m["last"] + 1)})
    assert found[0] and all(f == found[0] for f in found) and not list(tmp_path.iterdir())
