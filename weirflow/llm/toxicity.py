"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words are lower-cased runs of bytes that are neither ASCII punctuation nor white space; a hash
gives each a row of the embedding table. Filters of several widths run over the words, each
filter's largest value in the text counts, and a logistic layer weighs them. The model is fitted
in one task to at most ``SAMPLE`` labelled texts and ``SAMPLE_BYTES`` of text of each class, picked
by a hash of their ids; its size does not depend on the data. A part of the sample that training does not see sets the
calibration of scores. Rejection thresholds come from the scores of all learnable labelled texts
that training did not see, counted by language: each language's own best threshold, drawn to
that of all languages by ``SHRINK`` texts.

Scoring reads every whole text once, without a shuffle. Only the text enters a score. Texts are
read in pieces and their words' products are made ``WORDS`` at a time, so a text of any length
takes a fixed amount of memory beside its own bytes.

Defined cases: a null text is empty; an empty text has the score of a text of no words; labels
that are null or name no document are not used; without labels of both classes every score is
the share of toxic labels (0.0 without labels). Equal texts have equal scores, repeated ids too.
A row without an id is not held out. Extra columns are carried; one that has the name of the
score's column (in any case) is replaced.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm import common

#: Most labelled texts of each class that training and calibration use, and most bytes of them.
SAMPLE, SAMPLE_BYTES = 4000, 24 << 20
#: Rows and width of the embedding table, filters of each width, and the widths.
ROWS, DIM, FILTERS, WIDTHS = 1 << 19, 8, 12, (1, 2, 3)
EPOCHS, BATCH, RATE = 10, 64, 0.05
#: One of so many sampled texts calibrates instead of training.
CALIBRATE = 5
#: Words a worker remembers the rows of, and bytes beyond which a word is remembered by its digest.
REMEMBERED, LONG = 60_000, 128
#: Bytes of text that are split at a time, and words whose products are held at a time.
PIECE, WORDS = 1 << 20, 1 << 14
#: Bins of scores from which thresholds are chosen; labelled texts with which the threshold of all languages counts in each language's.
BINS, SHRINK = 1000, 200

_LOWER = bytes(32 if b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A word has the sum of three rows of the table: of itself and of its beginnings of so many bytes,
#: so that forms of a word which training has not seen share what is known of their stem.
STEMS = (5, 7)


class Words:
    """Numbers from 1 for the words met so far, and their rows of the table; 0 is the empty word."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.rows: list[tuple[int, ...]] = [(0,) * (1 + len(STEMS))]

    def of(self, words: list[bytes]) -> np.ndarray:
        """A number for each of the words."""
        keys = words
        if words and max(map(len, words)) > LONG:
            keys = [w if len(w) <= LONG else b"\0" + hashlib.blake2b(w, digest_size=16).digest() for w in words]
        for key, w in dict(zip(keys, words, strict=True)).items():
            if key not in self.number:
                self.number[key] = len(self.rows)
                self.rows.append(tuple(zlib.crc32(w[:n] + b"%d" % n if n else w) % (ROWS - 1) + 1 for n in (0, *STEMS)))
        return np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))


def pieces(text: str | bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, those of about ``PIECE`` bytes together."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    rest = b""
    for at in range(0, len(raw), PIECE):
        part = rest + raw[at : at + PIECE].translate(_LOWER)
        cut = len(part) if at + PIECE >= len(raw) else part.rfind(b" ") + 1  # a word may go on in the next piece
        yield part[:cut].split()
        rest = part[cut:]


def word_rows(texts: list[str | bytes | None]) -> list[np.ndarray]:
    """The table's rows of each text's words, ``1 + len(STEMS)`` a word; row 0 is never a word's."""
    words = Words()
    found = [np.concatenate([np.zeros(0, np.int64), *map(words.of, pieces(text))]) for text in texts]
    rows = np.array(words.rows, np.int32)
    return [rows[numbers] for numbers in found]


@dataclass
class Model:
    table: np.ndarray
    kernels: dict[int, np.ndarray]  # width -> (width, DIM, FILTERS)
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None
    trained: list[int] = field(default_factory=list)  # ids of the texts that training saw

    def embedded(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the words of all texts, each text followed by empty words; where texts begin, their sizes."""
        pad = max(WIDTHS)
        sizes = np.array([len(t) + pad for t in texts])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        rows = np.zeros((int(sizes.sum()), 1 + len(STEMS)), np.int64)
        for s, t in zip(starts, texts, strict=True):
            rows[s : s + len(t)] = t
        return rows, starts, sizes

    def pooled(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Per text and filter the largest value; all values by width. ``flat``: embedded words."""
        return self.largest(flat @ np.concatenate([k for w in WIDTHS for k in self.kernels[w]], axis=1), starts)

    def largest(self, products: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The same from each word's products with all filters' positions."""
        best, values, column = [], [], 0
        ends = np.append(starts[1:], len(products))
        for w in WIDTHS:
            z = products[:, column : column + FILTERS].copy()
            for j in range(1, w):
                z[:-j] += products[j:, column + j * FILTERS : column + (j + 1) * FILTERS]
                z[ends - j] = -np.inf  # would reach into the next text
            column += w * FILTERS
            best.append(np.maximum.reduceat(z, starts))
            values.append(z)
        return np.concatenate(best, 1), values

    def top_logits(self, top: np.ndarray) -> np.ndarray:
        return np.maximum(top + self.bias, 0) @ self.weights + self.offset

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        rows, starts, _ = self.embedded(texts)
        return self.top_logits(self.pooled(self.table[rows].sum(1), starts)[0])

    def score_of(self, logits: np.ndarray) -> np.ndarray:
        z = np.clip(logits.astype(np.float64) * self.scale + self.shift, -40, 40)
        return np.array([1 / (1 + math.exp(-x)) for x in z.tolist()])  # one by one: vector forms differ in the last bit by place


class Scorer:
    """Scores raw texts; remembers words' numbers and products with the filters, up to a bound.

    Every sum is made element by element in a fixed order, so a text's score does not depend on
    the texts that are scored with it.
    """

    def __init__(self, model: Model):
        self.model = model
        if model.constant is None:
            self.filters = np.concatenate([k for w in WIDTHS for k in model.kernels[w]], axis=1)
        self.clear()

    def clear(self) -> None:
        self.words, self.products, self.filled = Words(), np.zeros((1 << 12, FILTERS * sum(WIDTHS)), np.float32), 1

    def _learn(self) -> None:
        known = len(self.words.rows)
        while known > len(self.products):
            self.products = np.concatenate([self.products, np.zeros_like(self.products)])
        if known > self.filled:
            table = self.model.table[np.array(self.words.rows[self.filled :])]
            vectors = table[:, 0]
            for j in range(1, table.shape[1]):
                vectors = vectors + table[:, j]
            new = vectors[:, :1] * self.filters[0]
            for k in range(1, DIM):
                new += vectors[:, k : k + 1] * self.filters[k]
            self.products[self.filled : known] = new
            self.filled = known

    def scores(self, texts: list[str | bytes | None]) -> np.ndarray:
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant)
        top = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        parts: list[np.ndarray] = []
        owners: list[int] = []
        held = 0

        def settle() -> None:
            """The largest values of the parts that wait, each as if it were a text."""
            nonlocal held
            if parts:
                self._learn()
                starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
                best = self.model.largest(self.products[np.concatenate(parts)], starts)[0]
                np.maximum.at(top, np.array(owners), best)
            parts.clear()
            owners.clear()
            held = 0
            if len(self.words.rows) > REMEMBERED:
                self.clear()

        pad, lap = np.zeros(max(WIDTHS), np.int64), max(WIDTHS) - 1
        for k, text in enumerate(texts):
            carried: list[bytes] = []  # words whose windows reach into the next part
            for words in pieces(text):
                for at in range(0, len(words), WORDS):
                    if held >= WORDS:
                        settle()
                    some = carried + words[at : at + WORDS]
                    carried = some[-lap:]
                    if len(some) > lap:
                        parts.append(self.words.of(some))
                        owners.append(k)
                        held += len(some)
            parts.append(np.concatenate([self.words.of(carried), pad]))
            owners.append(k)
            held += len(parts[-1])
            if held >= WORDS:
                settle()
        settle()
        active = np.maximum(top + self.model.bias, 0).astype(np.float64)
        logits = np.full(len(texts), float(self.model.offset))
        for k, w in enumerate(self.model.weights):
            logits += active[:, k] * float(w)
        return self.model.score_of(logits)


def _new_model(rng: np.random.Generator) -> Model:
    kernels = {w: rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    n = FILTERS * len(WIDTHS)
    return Model(rng.normal(0, 0.05, (ROWS, DIM)).astype(np.float32) * 0.2, kernels, np.full(n, 0.1, np.float32), rng.normal(0, 0.3, n).astype(np.float32), 0.0)


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = 9) -> Model:
    """Adagrad on the logistic loss, classes weighted alike; untouched rows of the table become zero."""
    rng = np.random.default_rng(seed)
    model = _new_model(rng)
    seen = np.zeros(ROWS, bool)
    for t in texts:
        seen[t] = True
    model.table[~seen] = 0
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
    table_square = np.full(ROWS, 1e-2, np.float32)
    squares = {name: np.full_like(x, 1e-2) for name, x in [("bias", model.bias), ("weights", model.weights), *((w, model.kernels[w]) for w in WIDTHS)]}
    offset_square = 1e-2
    n = len(texts)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            rows = order[at : at + BATCH]
            part = [texts[r] for r in rows]
            words, starts, sizes = model.embedded(part)
            flat = model.table[words].sum(1)
            top, values = model.pooled(flat, starts)
            active = np.maximum(top + model.bias, 0)
            z = active @ model.weights + model.offset
            error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
            g_weights, g_offset = active.T @ error, float(error.sum())
            g_top = error[:, None] * model.weights * (top + model.bias > 0)
            g_bias = g_top.sum(0)
            doc_of = np.repeat(np.arange(len(rows)), sizes)
            g_rows, g_values = [], []
            g_kernels = {}
            for k, w in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                hit_row, hit_col = np.nonzero(values[k] == top[doc_of][:, cols])
                doc = doc_of[hit_row]
                _, first = np.unique(doc * FILTERS + hit_col, return_index=True)
                hit_row, hit_col, doc = hit_row[first], hit_col[first], doc[first]
                g = g_top[doc, k * FILTERS + hit_col]
                use = g != 0
                hit_row, hit_col, g = hit_row[use], hit_col[use], g[use]
                g_kernel = np.zeros_like(model.kernels[w])
                for j in range(w):
                    place = np.minimum(hit_row + j, len(words) - 1)
                    e = flat[place]
                    contribution = np.zeros((FILTERS, DIM), np.float32)
                    np.add.at(contribution, hit_col, g[:, None] * e)
                    g_kernel[j] = contribution.T
                    g_rows.append(words[place].ravel())
                    g_values.append(np.repeat(g[:, None] * model.kernels[w][j][:, hit_col].T, words.shape[1], axis=0))
                g_kernels[w] = g_kernel
            for name, x, g in [("bias", model.bias, g_bias), ("weights", model.weights, g_weights), *((w, model.kernels[w], g_kernels[w]) for w in WIDTHS)]:
                squares[name] += g * g
                x -= RATE * g / np.sqrt(squares[name])
            offset_square += g_offset**2
            model.offset -= RATE * g_offset / np.sqrt(offset_square)
            ids, back = np.unique(np.concatenate(g_rows), return_inverse=True)
            total = np.zeros((len(ids), DIM), np.float32)
            np.add.at(total, back, np.concatenate(g_values))
            total[ids == 0] = 0
            table_square[ids] += (total * total).mean(1)
            model.table[ids] -= 4 * RATE * total / np.sqrt(table_square[ids])[:, None]
    return model


def _best_threshold(counts: np.ndarray) -> float | None:
    """Middle of the gap between bins at which weighing errors of both kinds alike (F1) is best; ``counts``: bins by class."""
    if not counts.sum(0).all():
        return None
    above = np.cumsum(counts[::-1], 0)[::-1]
    f1 = 2 * above[:, 1] / (above.sum(1) + counts[:, 1].sum())
    best = int(np.argmax(f1))
    last = best
    while last + 1 < len(f1) and f1[last + 1] == f1[best]:
        last += 1
    return (best + last) / 2 / len(counts)


def set_thresholds(model: Model, scored: DataFrame, labels: DataFrame, score: str = "score") -> None:
    """Thresholds by language from ``scored`` documents (doc_id, lang and ``score``); only their counts reach the driver."""
    if model.constant is not None:
        return
    seen = scored.sparkSession.createDataFrame([(i,) for i in model.trained], "doc_id bigint")
    own = _usable(labels).join(F.broadcast(seen), "doc_id", "left_anti")  # at most 2 * sample ids
    place = F.least(F.floor(F.col(score) * BINS), F.lit(BINS - 1)).cast("int")
    rows = scored.select("doc_id", "lang", place.alias("bin")).join(own, "doc_id").groupBy("lang", "bin", "toxic").count().collect()
    counts: dict[str | None, np.ndarray] = {}
    for r in rows:
        counts.setdefault(r["lang"], np.zeros((BINS, 2)))[r["bin"], int(r["toxic"])] += r["count"]
    limit = lambda x: min(max(x, 0.3), 0.7)
    common_one = _best_threshold(sum(counts.values(), np.zeros((BINS, 2))))
    model.thresholds = {"": 0.5 if common_one is None else limit(common_one)}
    for language, found in counts.items():
        best = _best_threshold(found)
        if language and best is not None:
            n = found.sum()
            model.thresholds[language] = float((n * limit(best) + SHRINK * model.thresholds[""]) / (n + SHRINK))


def calibrate(model: Model, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> None:
    """Scale and shift so that scores are shares of toxic texts and 0.5 parts best."""
    z = np.concatenate([model.logits(texts[i : i + 256]) for i in range(0, len(texts), 256)]).astype(np.float64)
    spread = max(1e-6, z.std())
    a, b = 1.0 / spread, 0.0
    x, y = z / spread, labels.astype(np.float64)
    for _ in range(200):  # Newton's method, with a little pull towards the start
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        d = weights * (p - y)
        h = weights * p * (1 - p)
        g = np.array([(d * x).sum() + 1e-3 * a, d.sum() + 1e-3 * b])
        hess = np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-2]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if abs(step).max() < 1e-9:
            break
    a = min(max(a, 1e-3), 50.0)
    model.scale, model.shift = a / spread, b


def learnable(doc_id: Column | str) -> Column:
    """Rows that labels may be learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0


def _usable(labels: DataFrame) -> DataFrame:
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & learnable("doc_id"))
    return usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Sample at most ``sample`` labelled texts and ``SAMPLE_BYTES`` of each class, train, calibrate."""
    usable = _usable(labels)
    totals = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    if not all(totals.get(k) for k in (0, 1)):
        return Model(*[np.zeros(1)] * 4, 0.0, constant=1.0 if totals.get(1) else 0.0)
    by_hash = F.xxhash64(F.lit(9), "doc_id")
    picked = [usable.where(F.col("toxic") == k).orderBy(by_hash, "doc_id").limit(sample) for k in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * sample rows of two numbers
    raw = F.coalesce("text", F.lit("")).cast("binary")
    texts = docs.select("doc_id", raw.alias("text")).join(chosen, "doc_id").select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
    texts = common.materialize(texts.withColumn("digest", F.xxhash64("text")), "toxicity-sample")
    # Of the sample's texts those that ``SAMPLE_BYTES`` have room for, in an order that only ids and texts decide.
    sizes = texts.groupBy("doc_id", "toxic", "digest").agg(F.max(F.length("text")).alias("size"), F.count("*").alias("n"))
    room, taken = {0: SAMPLE_BYTES, 1: SAMPLE_BYTES}, []
    for r in sorted(sizes.collect(), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["digest"])):
        if r["size"] * r["n"] <= room[r["toxic"]]:
            room[r["toxic"]] -= r["size"] * r["n"]
            taken.append((r["doc_id"], r["digest"]))
    wanted = docs.sparkSession.createDataFrame(taken, "doc_id bigint, digest bigint")
    picked = texts.join(F.broadcast(wanted), ["doc_id", "digest"], "left_semi").select("doc_id", "toxic", "text")

    def work(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "toxic", "text")), strict=True), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[2]))
        made = packed(_fitted(rows, totals))
        del rows
        common.give_back()
        return pa.table({"model": pa.array([made], pa.binary())})

    # One task trains on the sample, whose size is bounded; a lost executor's work is done again by another.
    found = picked.groupBy().applyInArrow(work, "model binary").collect()
    common.release(texts)
    model = unpacked(found[0]["model"]) if found else _constant(totals)
    del found
    common.give_back()
    return model


def packed(model: Model) -> bytes:
    """A model's bytes; most rows of its table are zero."""
    return zlib.compress(pickle.dumps(model, protocol=5), 1)


def unpacked(raw: bytes) -> Model:
    return pickle.loads(zlib.decompress(raw))


def _constant(totals: dict[int, int]) -> Model:
    return Model(*[np.zeros(1)] * 4, 0.0, constant=totals[1] / (totals[0] + totals[1]))


def _fitted(rows: list[tuple[int, int, bytes]], totals: dict[int, int]) -> Model:
    """A model of rows (doc_id, label, text), calibrated for classes as frequent as ``totals``."""
    y = np.array([r[1] for r in rows])
    held = np.arange(len(rows)) % CALIBRATE == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        return _constant(totals)
    texts = word_rows([r[2] for r in rows])
    model = train([t for t, h in zip(texts, held, strict=True) if not h], y[~held])
    of_class = np.array([(y == k).sum() for k in (0, 1)])
    weights = np.array([totals[k] / of_class[k] for k in y[held]])  # classes as frequent as among all labels
    calibrate(model, [t for t, h in zip(texts, held, strict=True) if h], y[held], weights * held.sum() / weights.sum())
    model.trained = sorted({r[0] for r, h in zip(rows, held, strict=True) if not h})
    return model


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """All of ``docs`` with the column ``into``."""
    shared = docs.sparkSession.sparkContext.broadcast(packed(model))  # fixed size: ROWS * DIM numbers at most
    kept: dict = {}
    docs = docs.drop(*(c for c in docs.columns if c.lower() == into.lower()))
    names = docs.columns
    place = names.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept.get("scorer") or kept.setdefault("scorer", Scorer(unpacked(shared.value)))
        for batch in batches:
            for part in common.slices(batch, place, 2 << 20):
                raw = part.column(place).cast(pa.binary())
                found = np.concatenate([own.scores(raw.slice(k, 64).to_pylist()) for k in range(0, len(raw), 64)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], names=[*names, into])
        kept.clear()
        del own
        common.give_back()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{into}` double"])
    return docs.mapInArrow(work, schema)


def rejected(model: Model, lang: Column | None = None, score: str = "score") -> Column:
    """Whether a scored row reaches the threshold of its language (that of all languages where it has none)."""
    limit = F.lit(model.thresholds.get("", 0.5))
    for language, value in sorted(model.thresholds.items()):
        if language and lang is not None:
            limit = F.when(lang == language, F.lit(value)).otherwise(limit)
    return F.col(score) >= limit


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = common.documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(~learnable("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
