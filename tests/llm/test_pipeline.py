import corpus_pipeline
from tests.llm.helpers import HARD, docs_frame, prose

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    labels = spark.createDataFrame([(k, 0, 0) for k in range(9)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    t = prose(60, 4)
    texts = [*HARD, t, t, "key token = abcdefgh123 end"]
    docs = docs_frame(spark, texts).select(*COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == COLUMNS and kept.count() == len(texts)
    one = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    ids = {r["doc_id"] for r in one.collect()}
    assert one.columns == COLUMNS and ids == set(range(len(texts))) - {6, len(HARD) + 1}
    clean = {r["doc_id"]: r for r in corpus_pipeline.redact_secrets(spark, docs, str(tmp_path)).collect()}
    assert clean[len(texts) - 1]["text"] == "key [SECRET] end" and clean[len(texts) - 1]["n_chars"] == 16
    assert all(clean[k]["text"] == x for k, x in enumerate(texts[:-1]))
    mixed = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    assert mixed.columns == COLUMNS and {r["text"] for r in mixed.collect()} <= set(texts)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and {"doc_id", "ids", "n_tokens"} <= set(out.columns)


def test_repeated_rows_and_null_ids(spark):
    docs = docs_frame(spark, ["a b c", "a b c", "d", None], [1, 1, None, None]).select(*COLUMNS)
    assert corpus_pipeline.drop_near_duplicates(spark, docs, "").count() == 3
    assert corpus_pipeline.mix_sources(spark, docs, "").columns == COLUMNS


def test_copies_without_ids(spark):
    t, other = prose(60, 4), prose(60, 9)
    near = other + " one"
    texts = [t, t, t, other, near, None, "", None, "alone"]
    docs = docs_frame(spark, texts, [7, None, None, None, None, None, None, 8, None]).select(*COLUMNS)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert (7, t) in kept and (None, t) not in kept and (8, None) in kept
    assert sum(x in (other, near) for _, x in kept) == 1
    assert sorted((x is None, x or "") for i, x in kept if i is None and x in (None, "", "alone")) == [(False, ""), (False, "alone"), (True, "")]
    assert len(kept) == 6


def shuffled_bytes(df):
    """Bytes in all exchanges of the plan of a frame that was collected."""
    total, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            nodes.append(node.plan())
        if name == "ShuffleExchangeExec":
            total += node.metrics().apply("dataSize").value()
        nodes += [node.children().apply(k) for k in range(node.children().size())]
    return total


def test_texts_that_stay_are_not_shuffled(spark):
    texts = [prose(400, 500 + k) for k in range(300)]
    docs = docs_frame(spark, [*texts, texts[7], texts[8]]).select(*COLUMNS)
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in held:  # as at scale, where ids are too many to be broadcast
        spark.conf.set(k, "-1")
    try:
        one = corpus_pipeline.drop_near_duplicates(spark, docs, "")
        assert {r["doc_id"] for r in one.collect()} == set(range(300))
        assert 0 < shuffled_bytes(one) < sum(map(len, texts)) / 4
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
