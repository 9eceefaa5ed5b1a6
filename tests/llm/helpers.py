"""Small fixtures with every hard case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, __n int, kept string"


def docs_frame(spark, texts, ids=None, sources=None):
    rows = []
    for k, t in enumerate(texts):
        rows.append((ids[k] if ids else k, t, "en", sources[k] if sources else f"src{k % 3}", len(t or ""), 1.0, "x", 7, "y"))
    return spark.createDataFrame(rows, SCHEMA)


PROSE = "the cat sat on a mat and then it ran off over the hill into the dark green wood where no one lives now at all".split()


def prose(n, seed=0):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(PROSE) + str(r.randrange(50)) for _ in range(n))


HARD = [None, "", " \t\n", "one", "aaaa", prose(400, 1), prose(400, 1), prose(30, 2), "ünï çödé 漢字 \U0001f600 " * 9, "x" * 3000, prose(9000, 3), "<|endoftext|> a<|endoftext|>", "tab\tsep\x0bvt\x0cff\x1cfs\x85nel nbsp"]
