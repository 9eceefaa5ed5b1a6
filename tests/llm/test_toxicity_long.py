"""Long texts in pieces, clashing names and rows without ids."""

import resource

import numpy as np

from tests.llm.helpers import docs_frame, prose
from weirflow.llm import toxicity


def model():
    rng = np.random.default_rng(2)
    made = toxicity._new_model(rng)
    made.table[0] = 0
    made.scale = 0.1
    return made


def test_pieces_do_not_matter(monkeypatch):
    texts = [None, "", "one", "one two", prose(3000, 1), "x" * 5000, "a  b" * 900, prose(40, 2) + " " + "z" * 300 + " end"]
    whole = toxicity.Scorer(model()).scores(texts)
    for words, piece, remembered in ((16, 1 << 20, 60_000), (1 << 14, 50, 60_000), (7, 33, 5)):
        for name, value in (("WORDS", words), ("PIECE", piece), ("REMEMBERED", remembered)):
            monkeypatch.setattr(toxicity, name, value)
        assert (toxicity.Scorer(model()).scores(texts) == whole).all()
        assert [float(toxicity.Scorer(model()).scores([t])[0]) for t in texts] == whole.tolist()


def test_memory_of_a_long_text():
    scorer, text = toxicity.Scorer(model()), (prose(100_000, 3) + " ").encode() * 70
    text = text[:40_000_000] + b"y" * 10_000_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert len(text) == 50_000_000 and 0 <= scorer.scores([text])[0] <= 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300 << 10


def test_column_of_the_score_and_null_ids(spark, tmp_path):
    docs = docs_frame(spark, ["a", None, "b c"], [1, None, 2])
    out = toxicity.score(docs, model())
    assert sorted(out.columns) == sorted(docs.columns) and out.where("score between 0 and 1 and score <> 1.0").count() == 3
    assert toxicity.score(docs, model(), into="other").where("score = 1.0 and other < 1").count() == 3
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 0, k % 2) for k in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [r["held_out"] for r in toxicity.op9_toxicity(spark, str(tmp_path)).collect() if r["doc_id"] is None] == [False]


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 2000)
    docs = docs_frame(spark, [prose(20, k) for k in range(200)] + [prose(5000, 7)])
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(201)], "doc_id long, quality int, toxic int")
    assert 0 < len(toxicity.fit(docs, labels).trained) < 40
