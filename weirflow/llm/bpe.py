"""BPE encoding and decoding by a segment tree over adjacent pair ranks.

A pretoken's bytes are the leaves' left ends; leaf ``i`` holds ``rank << 20 | i`` of the pair
that starts at symbol ``i``, or a value above all where that pair cannot merge. The root's
minimum is therefore the leftmost pair of lowest rank. A merge changes at most three leaves
(the pair itself, the one before, and the one that vanished), each repaired on its path to
the root, until the root says that no pair is left. Many pretokens are handled at once: one
row of a matrix is one tree, and each step makes one merge in each tree that still has one.

Nulls are empty texts; an empty text has no ids and decodes to itself. Repeated rows and
ties are independent of each other. Extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm import vocabulary as vocab
from weirflow.llm.common import give_back, slices

#: Pretokens a worker remembers; beyond that it starts over, so memory is bounded.
REMEMBERED = 400_000
#: Symbols of trees that one step handles together.
CELLS = 1 << 21

_TOP = np.int64(1) << 60
_SHIFT = np.int64(20)  # leaves, and so bytes of a pretoken; longer ones are handled with a wider shift


class PairTable:
    """Ranks of id pairs, looked up for whole arrays: open addressing with a fixed multiplier."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        size = 1 << max(4, (len(merges) * 4 - 1).bit_length())
        self.mask = np.int64(size - 1)
        self.keys = np.full(size, -1, np.int64)
        self.values = np.zeros(size, np.int64)
        pairs = np.array(list(merges), np.int64).reshape(-1, 2)
        self.merged = np.zeros(len(merges), np.int64)
        keys, ranks = pairs[:, 0] << np.int64(32) | pairs[:, 1], np.array([r for r, _ in merges.values()], np.int64)
        self.merged[ranks] = np.array([i for _, i in merges.values()], np.int64)
        slots = self._slot(keys)
        waiting = np.arange(len(keys))
        while len(waiting):
            at = slots[waiting]
            free = self.keys[at] == -1
            _, first = np.unique(at[free], return_index=True)
            placed = waiting[free][first]
            self.keys[slots[placed]], self.values[slots[placed]] = keys[placed], ranks[placed]
            waiting = np.setdiff1d(waiting, placed, assume_unique=True)
            slots[waiting] = (slots[waiting] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(33)).astype(np.int64) & self.mask

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        keys = left << np.int64(32) | right
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class Coder:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, path: str):
        self.vocabulary = vocab.load(path)
        self.pairs = PairTable(self.vocabulary.merges)
        self.known: dict[str, bytes] = {}
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in self.vocabulary.special.items()}

    # -- encoding

    def learn(self, pretokens: Iterable[str]) -> None:
        """Encode the pretokens and remember their ids as little-endian 32-bit integers."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for p in pretokens:
            raw = p.encode("utf-8", "surrogatepass")
            by_size.setdefault(max(1, len(raw) - 2).bit_length(), []).append((p, raw))
        for words in by_size.values():
            widest = max(len(raw) for _, raw in words)
            rows = max(1, CELLS // widest)
            for start in range(0, len(words), rows):
                part = words[start : start + rows]
                flat, ends = self.merge_all([raw for _, raw in part])
                begin = 0
                for (p, _), end in zip(part, ends, strict=True):
                    self.known[p] = flat[begin:end]
                    begin = end

    def merge_all(self, words: list[bytes]) -> tuple[bytes, list[int]]:
        """Ids of all byte strings in one run of bytes, and where each one's end; one segment tree a row."""
        m, sizes = len(words), np.array([len(w) for w in words])
        width = int(sizes.max())
        leaves = 1 << max(0, (width - 2)).bit_length() if width > 2 else 1
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(m, width)
        ids = self.vocabulary.byte_ids[flat]
        inside = np.arange(width) < sizes[:, None]
        shift = max(_SHIFT, np.int64(width.bit_length()))
        after = np.broadcast_to(np.arange(1, width + 1), (m, width)).copy()  # next living symbol
        before = np.broadcast_to(np.arange(-1, width - 1), (m, width)).copy()
        alive = inside.copy()
        tree = np.full((m, 2 * leaves), _TOP, np.int64)
        if width > 1:
            rank = self.pairs.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(m, width - 1)
            ok = (rank >= 0) & inside[:, 1:]
            tree[:, leaves : leaves + width - 1] = np.where(ok, rank << shift | np.arange(width - 1), _TOP)
            node = leaves
            while node > 1:
                tree[:, node // 2 : node] = np.minimum(tree[:, node : 2 * node : 2], tree[:, node + 1 : 2 * node : 2])
                node //= 2
        rows = np.flatnonzero(tree[:, 1] < _TOP)
        low = (np.int64(1) << shift) - 1
        while len(rows):
            root = tree[rows, 1]
            at = root & low
            gone = after[rows, at]
            ids[rows, at] = self.pairs.merged[root >> shift]
            alive[rows, gone] = False
            following = after[rows, gone]
            after[rows, at] = following
            has_next = following < sizes[rows]
            before[rows[has_next], following[has_next]] = at[has_next]
            previous = before[rows, at]
            has_previous = previous >= 0
            # New keys of the three leaves that changed; a leaf past the last pair does not exist.
            r = np.concatenate([rows, rows[has_previous], rows[gone < leaves]])
            leaf = np.concatenate([at, previous[has_previous], gone[gone < leaves]])
            key = np.full(len(r), _TOP, np.int64)
            n, q = len(rows), int(has_previous.sum())
            rank = self.pairs.ranks(ids[rows[has_next], at[has_next]], ids[rows[has_next], following[has_next]])
            key[:n][has_next] = np.where(rank >= 0, rank << shift | at[has_next], _TOP)
            rank = self.pairs.ranks(ids[rows[has_previous], previous[has_previous]], ids[rows[has_previous], at[has_previous]])
            key[n : n + q] = np.where(rank >= 0, rank << shift | previous[has_previous], _TOP)
            node = leaf + leaves
            tree[r, node] = key
            while leaves > 1 and node[0] > 1:
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
            rows = rows[tree[rows, 1] < _TOP]
        return ids[alive].astype("<u4").tobytes(), (np.cumsum(alive.sum(1)) * 4).tolist()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        find, split = self.vocabulary.pattern.findall, []
        for text in texts:
            parts = vocab.segments(self.vocabulary, text or "")
            split.append([find(p) if k % 2 == 0 else p for k, p in enumerate(parts)])
        used = set()
        for parts in split:
            for k in range(0, len(parts), 2):
                used.update(parts[k])
        if len(self.known) + len(used) > REMEMBERED:
            self.known.clear()
        self.learn(w for w in used if w not in self.known)
        known = self.known.__getitem__
        return [b"".join(b"".join(map(known, p)) if k % 2 == 0 else self.special[p] for k, p in enumerate(parts)) for parts in split]

    # -- decoding

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters, special ids their strings."""
        pieces = map(self.vocabulary.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())
        return b"".join(pieces).decode("utf-8", "replace")


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """One coder a worker and path, kept for later tasks of that worker."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def encode_decode(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """Columns ``keep``, then ``n_tokens``, ``ids`` (array<int>), ``decoded``, and their digests.

    One pass without a shuffle; each task holds some megabytes of text and the remembered pretokens.
    """
    path = path or vocab.default_path()
    fields = [docs.schema[k] for k in keep]
    columns = [*((f.name, f.dataType.simpleString()) for f in fields), ("n_tokens", "bigint"), *([("ids", "array<int>")] * with_ids), *([("decoded", "string")] * with_text), ("ids_sha256", "string"), ("decoded_sha256", "string")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            for part in slices(batch, "__text", 2 << 20):
                ids = own.encode(part.column("__text").to_pylist())
                decoded = [own.decode(i) for i in ids]
                out = [part.column(k) for k in range(len(keep))]
                out.append(pa.array([len(i) // 4 for i in ids], pa.int64()))
                if with_ids:
                    ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
                    out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                if with_text:
                    out.append(pa.array(decoded, pa.string()))
                out.append(pa.array([hashlib.sha256(i).hexdigest() for i in ids]))
                out.append(pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in decoded]))
                yield pa.RecordBatch.from_arrays(out, names=[n for n, _ in columns])
        give_back()

    schema = ", ".join(f"`{n}` {t}" for n, t in columns)
    return docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text")).mapInArrow(work, schema)


def op2_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_decode(docs, with_ids=False, with_text=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
