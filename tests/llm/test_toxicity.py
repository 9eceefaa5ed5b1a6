import os

import duckdb
import pytest

from tests.llm.helpers import HARD, docs_frame
from weirflow.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in toxicity.op9_toxicity(spark, SF).collect()}
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall()
    held = [(rows[i], t) for i, t in labels if rows[i]["held_out"]]
    hit = sum(r["predicted"] for r, t in held if t)
    false = sum(r["predicted"] for r, t in held if not t)
    assert hit >= 0.75 * sum(t for _, t in held) and false <= 0.02 * sum(1 - t for _, t in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())


def test_corner_cases(spark):
    docs = docs_frame(spark, [*HARD, *HARD])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(docs.drop("score"), toxicity.fit(docs, none)).collect()} == {0.0}
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(26)] + [(None, 1, 1), (3, 1, None), (999, 0, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.score(docs.drop("score"), toxicity.fit(docs, labels)).collect()
    by_text = {}
    for r in found:
        by_text.setdefault(r["text"] or "", set()).add(r["score"])
    assert len(found) == 26 and all(len(s) == 1 for s in by_text.values())
    empty = docs_frame(spark, []).drop("score")
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_thresholds_use_all_labels_and_every_language(spark):
    model = toxicity.Model(*[toxicity.np.zeros(1)] * 4, 0.0, trained=[0, 1])
    rows, labels = [], []
    for k in range(9000):
        lang, toxic = ("en", "fr", "es", None)[0 if k < 8000 else 1 if k < 8900 else 2 if k < 8990 else 3], k % 10 == 0
        cut = {"en": 0.5, "fr": 0.35, "es": 0.65, None: 0.5}[lang]
        rows.append((k, lang, cut + (0.05 if toxic else -0.05)))
        labels.append((k, 0, int(toxic)))
    scored = spark.createDataFrame(rows, "doc_id long, lang string, score double")
    toxicity.set_thresholds(model, scored, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    t = model.thresholds
    assert set(t) == {"", "en", "fr", "es"}
    assert abs(t["en"] - 0.5) < 0.06 and 0.3 <= t["fr"] < t["en"] < t["es"] <= 0.7
    n = sum(toxicity.zlib.crc32(str(k).encode()) % 5 != 0 for k in range(8900, 8990))  # few texts: near the threshold of all
    assert abs(t["es"] - (n * 0.65 + 200 * t[""]) / (n + 200)) < 0.03
