"""Media columns: payloads in tar shards, addressed by content.

``store`` turns each text into 8-bit samples, packs them as a greyscale PNG (576 samples a
line, no line filter, deflate) and appends it to a tar shard in the shared folder under the
payload's digest; a payload that the shard holds already is not written again. Rows carry
digest, shard, offset and length. ``describe`` fills the metadata columns by range reads of
the headers alone; ``features`` reads the stored bytes back.

A shard's name holds its task attempt, and only rows of attempts that Spark committed name a
shard, so a lost or repeated task leaves at most an unnamed file. No text is shuffled. Copies
in different shards are stored once a shard.

A null text is empty; an empty text is one line of bytes 255. Equal texts give equal values.
Extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm import common

#: Samples of a line, and so the unit of payloads.
LINE = 576
#: Media bytes after which a task begins another shard.
SHARD_BYTES = 64 << 20
#: Bytes of a shard that one reading task takes together.
READ_BYTES = 16 << 20
#: Signature, length, type and content of a PNG's first chunk.
HEADER_BYTES = 29
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_BLOCK = 512


def payload_of(raw: bytes) -> bytes:
    """Bytes 255 are appended up to a positive multiple of ``LINE``."""
    return raw + b"\xff" * (-len(raw) % LINE if raw else LINE)


def png(payload: bytes, level: int = 6) -> bytes:
    """A greyscale image of ``LINE`` 8-bit samples a line."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    raw = np.zeros((len(lines), LINE + 1), np.uint8)  # a leading 0: no filter
    raw[:, 1:] = lines

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", LINE, len(lines), 8, 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from an image's first ``HEADER_BYTES`` bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", head[16:25])


def png_samples(media: bytes) -> bytes:
    """The samples of an image that ``png`` made."""
    width, height, _ = png_header(media[:HEADER_BYTES])
    at, data = 8, []
    while at < len(media):
        (size,) = struct.unpack(">I", media[at : at + 4])
        if media[at + 4 : at + 8] == b"IDAT":
            data.append(media[at + 8 : at + 8 + size])
        at += size + 12
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    return raw[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """A 64-bit mean hash over 64 equal runs of the samples, then least, largest and mean sample."""
    samples = np.frombuffer(payload, np.uint8)
    runs = samples.reshape(64, -1).sum(1, dtype=np.int64)
    bits = np.packbits(runs * 64 >= runs.sum())
    mean = int(runs.sum()) * 1000 // len(samples)
    return f"{bits.tobytes().hex()}:{samples.min()}:{samples.max()}:{mean}"


class Shard:
    """One tar file being written; ``add`` returns where the media's bytes lie."""

    def __init__(self, folder: str):
        self.path = f"{folder}/shard-{uuid.uuid4().hex}.tar"
        store, inner = fs.FileSystem.from_uri(self.path)
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(inner)
        self.at = 0
        self.held: dict[str, tuple[int, int]] = {}

    def add(self, digest: str, payload: bytes) -> tuple[int, int]:
        if digest not in self.held:
            media = png(payload)
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(media)
            self.out.write(info.tobuf(tarfile.USTAR_FORMAT) + media + b"\0" * (-len(media) % _BLOCK))
            self.held[digest] = self.at + _BLOCK, len(media)
            self.at += _BLOCK + len(media) + -len(media) % _BLOCK
        return self.held[digest]

    def close(self) -> None:
        self.out.write(b"\0" * 2 * _BLOCK)
        self.out.close()


def store(docs: DataFrame, folder: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Write all payloads; columns ``keep``, ``n_bytes``, ``digest``, ``shard``, ``offset``, ``length``.

    The returned table is already written to the shared folder: reading it twice writes no shard twice.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting = None, []

        def done() -> Iterator[pa.RecordBatch]:
            shard.close()
            yield from waiting

        for batch in batches:
            for part in common.slices(batch, "__text"):
                if shard is None:
                    shard = Shard(folder)
                rows = []
                for t in part.column("__text").cast(pa.binary()).to_pylist():
                    payload = payload_of(t)
                    digest = hashlib.sha256(payload).hexdigest()
                    rows.append((len(t), digest, shard.path, *shard.add(digest, payload)))
                columns = [*(part.column(k) for k in range(len(keep))), *(pa.array(c) for c in zip(*rows, strict=True))]
                waiting.append(pa.RecordBatch.from_arrays(columns, names=[*keep, "n_bytes", "digest", "shard", "offset", "length"]))
                if shard.at >= SHARD_BYTES:
                    yield from done()
                    shard, waiting = None, []
        if shard is not None:
            yield from done()

    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), "n_bytes bigint, digest string, shard string, offset bigint, length bigint"])
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text")).mapInArrow(work, schema)
    return common.materialize(rows, "media-rows")


def _near(rows: DataFrame) -> DataFrame:
    """Rows whose bytes lie near each other in a shard go to one task, some megabytes together."""
    return rows.repartition(common.partitions_for(rows), "shard", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("shard", "offset")


def _read(rows: DataFrame, extra: str, each) -> DataFrame:
    names = rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source, last, value = None, None, None, None
        for batch in batches:
            found = []
            for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if shard != path:
                    if source is not None:
                        source.close()
                    store_, inner = fs.FileSystem.from_uri(shard)
                    path, source = shard, store_.open_input_file(inner)
                if (shard, offset) != last:
                    last, value = (shard, offset), each(source, offset, length)
                found.append(value)
            columns = [*(batch.column(c) for c in names), *(pa.array(c) for c in zip(*found, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *(x.split()[0] for x in extra.split(", "))])
        if source is not None:
            source.close()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), extra])
    return _near(rows).mapInArrow(work, schema)


def describe(rows: DataFrame) -> DataFrame:
    """Adds ``width``, ``height`` and ``bit_depth``, read from the first bytes of each image alone."""

    def each(source, offset: int, length: int):
        return png_header(source.read_at(HEADER_BYTES, offset))

    return _read(rows, "width bigint, height bigint, bit_depth bigint", each)


def features(rows: DataFrame) -> DataFrame:
    """Adds what the whole stored bytes say: digests, checksum, sizes and a feature of the samples."""

    def each(source, offset: int, length: int):
        media = source.read_at(length, offset)
        payload = png_samples(media)
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload))

    return _read(rows, "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string", each)


def op8_media_columns(spark, sf_dir: str) -> DataFrame:
    """Metadata of every document's stored payload from its header alone, and the digest columns read back from its shard."""
    rows = store(common.documents(spark, sf_dir), common.new_path(spark, "media"))
    return features(describe(rows)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
