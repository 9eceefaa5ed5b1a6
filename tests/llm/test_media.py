import hashlib
import io
import tarfile
import zlib

from tests.llm.helpers import HARD, docs_frame
from weirflow.llm import common, media


def test_round_trip(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(media, "SHARD_BYTES", 4000)
    texts = HARD + ["a" * 575, "a" * 576, "a" * 577]
    folder = f"file://{tmp_path}/media"
    rows = media.store(docs_frame(spark, texts).repartition(2), folder)
    got = {r["doc_id"]: r for r in media.features(rows).collect()}
    heads = {r["doc_id"]: r for r in media.describe(rows).collect()}
    members = {}
    for path in (tmp_path / "media").iterdir():
        if path.suffix == ".tar":
            with tarfile.open(path) as tar:
                names = [m.name for m in tar]
                assert len(set(names)) == len(names)
                for m in tar:
                    members[m.name] = tar.extractfile(m).read()
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["digest"] == r["payload_sha256"] and r["tail_crc32"] == zlib.crc32(payload[-32:])
        stored = members[f"{r['digest']}.png"]
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert media.png_samples(stored) == payload and r["feature"] == media.feature_of(payload)
        assert (heads[k]["width"], heads[k]["height"], heads[k]["bit_depth"]) == (576, len(payload) // 576, 8)


def test_empty_table(spark):
    rows = media.store(docs_frame(spark, []), common.new_path(spark, "media"))
    assert media.features(rows).count() == 0


def test_query_takes_metadata_from_headers(spark, monkeypatch, tmp_path):
    docs_frame(spark, HARD).write.parquet(f"{tmp_path}/documents.parquet")
    described, describe = [], media.describe
    monkeypatch.setattr(media, "describe", lambda rows: described.append(1) or describe(rows))
    rows = media.op8_media_columns(spark, str(tmp_path)).collect()
    assert described and len(rows) == len(HARD)
    assert all((r["width"], r["height"]) == (576, r["payload_bytes"] // 576) for r in rows)
