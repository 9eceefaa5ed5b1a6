"""The queries of this subpackage, by name, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from weirflow.llm import bpe, hmm, media, minhash, mixing, secrets, suffix_dedup, token_counts, toxicity, vectors


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_bpe_round_trip": bpe.op2_bpe_round_trip,
        "op3_minhash_near_dedup": minhash.op3_minhash_near_dedup,
        "op4_lm_scoring": hmm.op4_lm_scoring,
        "op5_mixing": mixing.op5_mixing,
        "op6_secret_scans": secrets.op6_secret_scans,
        "op7_embedding_near_dedup": vectors.op7_embedding_near_dedup,
        "op8_media_columns": media.op8_media_columns,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_token_counts": token_counts.op10_token_counts,
    }


_REACH = """r AS (SELECT id, id AS m FROM v UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.m),
c AS (SELECT id, min(m) AS component FROM r GROUP BY id)"""

_NEAR_TEXTS = rf"""WITH RECURSIVE v AS (SELECT doc_id AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM v WHERE len(w) > 0),
n AS (SELECT id, count(*) AS k FROM s GROUP BY id),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.id <> y.id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 10 * p.k >= 8 * (x.k + y.k - p.k)),
{_REACH}
SELECT d.doc_id, c.component AS class_id, d.doc_id = c.component AS kept FROM documents d JOIN c ON c.id = d.doc_id"""

_NEAR_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id <> y.id WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
{_REACH}
SELECT c.id AS vec_id, (SELECT count(*) FROM l WHERE l.a = c.id) AS n_links, component AS component_id, c.id = component AS kept FROM c"""


def oracle_sql() -> dict[str, str]:
    """Brute force over all pairs. The other queries are beyond SQL; tests hold them against brute-force versions."""
    return {"op3_minhash_near_dedup": _NEAR_TEXTS, "op7_embedding_near_dedup": _NEAR_VECTORS}
