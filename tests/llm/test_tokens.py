import hashlib
import struct

import numpy as np
from tokenizers import Tokenizer

from tests.llm.helpers import HARD, docs_frame
from weirflow.llm import bpe, token_counts, vocabulary

T = Tokenizer.from_file(vocabulary.default_path())


def ids_of(text):
    return T.encode(text or "", add_special_tokens=False).ids


def odd_texts():
    import random

    r = random.Random(5)
    alphabet = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x3000, 0x180E, 0xFEFF, 0x1F600, 0x4E00, 0x661, 0x2160]]
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(50))) for _ in range(1500)]


def test_round_trip(spark):
    texts = [*HARD, *odd_texts()]
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs_frame(spark, texts).repartition(3)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        ids = ids_of(t)
        assert got[k]["ids"] == ids and got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        decoded = T.decode(ids, skip_special_tokens=False)
        assert got[k]["decoded"] == decoded == (t or "")
        assert got[k]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_counts(spark):
    texts = [*HARD, *odd_texts()]
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs_frame(spark, texts)).collect()}
    for k, t in enumerate(texts):
        n = len(ids_of(t))
        assert (got[k]["n_tokens"], got[k]["n_bytes"], got[k]["over_limit"]) == (n, len((t or "").encode()), n > 512)


def test_memory_bound(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    coder = bpe.Coder(vocabulary.default_path())
    texts = ["a b c d e", "f g h", "a b"]
    assert [np.frombuffer(x, "<u4").tolist() for t in texts for x in coder.encode([t])] == [ids_of(t) for t in texts]


def test_empty_table(spark):
    assert bpe.encode_decode(docs_frame(spark, [])).count() == 0
    assert token_counts.token_counts(docs_frame(spark, [])).count() == 0
