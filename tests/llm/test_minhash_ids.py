from tests.llm.helpers import docs_frame, prose
from weirflow.llm import minhash


def test_repeated_ids_with_different_texts(spark):
    a, b, c = prose(80, 1), prose(80, 2), prose(80, 3)
    near = lambda t: t + " more"
    rows = minhash.classes(docs_frame(spark, [a, b, near(a), c, near(b), c, None, "", c], [1, 1, 2, 3, 0, 3, 3, 9, None])).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in rows if r["doc_id"] is not None) == [(0, 0), (1, 0), (1, 0), (2, 0), (3, 3), (3, 3), (3, 3), (9, 9)]
    rows = minhash.classes(docs_frame(spark, [a, b, near(a)], [1, 1, 2])).collect()
    assert {(r["doc_id"], r["class_id"]) for r in rows} == {(1, 1), (2, 1)}
