"""Hidden Markov language model: Baum-Welch over the corpus, scaled forward recursion for scores.

Tokens are words with A-Z in lower case, then one end a text. Words that occur at least
``sqrt(training tokens) / HEAD`` times are symbols of their own: at most ``HEAD`` times the root of
the tokens, a table that grows with the corpus, up to ``MOST_SYMBOLS``, as it is broadcast; every other word is emitted through one of ``CLASSES`` classes made of its
first and last bytes, and within its class in proportion to its training count plus one, words
never seen counting together as one more of the class. A state's emissions are its expected
counts smoothed with the corpus's; all probabilities of a step sum to one.

Data flow: documents become chunks of some megabytes, written once. A chunk's distinct words and
training counts are dealt by word hash; the task that holds a hash sums its counts over all
chunks and answers each chunk in the same pass, so no (document, word) pair is ever shuffled. Each
Baum-Welch round is one pass over the chunks; the tasks' expected counts are summed by symbol
range, and only the sums, whose number is bounded, reach the driver. The start is a seeded
perturbation of the corpus's counts; rounds over all training documents follow until the
likelihood settles.

Words are told apart by 64-bit hashes (at V words some pair collides with chance V**2 / 2**65).

Defined cases: a null text is empty and holds one end; a null id is a training document; an
empty table gives no rows; with no training documents all words are unknown. Equal texts have
equal scores. Extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm import common

STATES = 5
#: The likelihood has settled where ``STILL`` rounds in a row gain less than this share of it; after one such round it may rise again.
SETTLED, STILL = 1e-5, 2
#: A word is a symbol of its own from the root of the training tokens over ``HEAD`` occurrences on.
HEAD, MOST_SYMBOLS = 30, 2_000_000
CLASSES = 8192
#: Bytes of text of a chunk; words a worker remembers.
CHUNK, REMEMBERED = 12 << 20, 300_000
#: Most ranges of hashes to which a chunk's words are dealt beyond the session's partitions.
MOST_RANGES = 8192
#: Tokens of documents whose recursions run together, and tokens that wait to be grouped by length.
BATCH, WAITING = 1 << 20, 6 << 20
#: Parts by which symbols' sums are dealt to tasks.
PARTS = 16
#: Weight of the corpus's distribution in a state's, in tokens: a share of all tokens, and at least so many.
PRIOR_SHARE, PRIOR_LEAST = 1e-4, 50.0
END = b"\n"  # no word holds white space

_known: dict[bytes, tuple[int, int]] = {}


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Tokens a text, all tokens as places in a list of distinct words, and that list, the end last.

    Arrow's white space is the contract's, and its lower case is of A-Z only.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # at least one, maybe empty, word a text
    flat = split.flatten()
    word = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))[:-1]]).astype(np.int64)
    lengths = np.add.reduceat(word.astype(np.int64), starts) + 1 if len(starts) else np.zeros(0, np.int64)
    coded = flat.filter(pa.array(word)).dictionary_encode()
    words = [*coded.dictionary.cast(pa.binary()).to_pylist(), END]
    tokens = np.full(int(lengths.sum()), len(words) - 1, np.int32)
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(lengths) - 1] = False
    tokens[inner] = coded.indices.to_numpy(zero_copy_only=False)
    return lengths, tokens, words


def _hash_class(word: bytes) -> tuple[int, int]:
    """64-bit hash and emission class of a word."""
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"), zlib.crc32(word[:4] + b" " + word[-2:]) % CLASSES


END_HASH = _hash_class(END)[0]


def held_out(doc_id: Column | str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


# -- chunks and counts


def make_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row a chunk: ids and held-out flags of its documents, their lengths, tokens as places in the
    chunk's list of distinct words, and for each of these hash, class and training count."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", CHUNK):
                if len(_known) > REMEMBERED:
                    _known.clear()
                lengths, flat, words = tokens_of(part.column("text"))
                for w in words:
                    if w not in _known:
                        _known[w] = _hash_class(w)
                held = np.array(part.column("held").to_pylist(), bool)
                trains = np.repeat(~held, lengths)
                counts = np.bincount(flat[trains], minlength=len(words)).astype(np.int32)
                hashes, classes = (np.array(x) for x in zip(*map(_known.__getitem__, words), strict=True))
                hashes = hashes.astype(np.uint64)
                order = np.argsort(hashes, kind="stable")
                back = np.empty_like(order)
                back[order] = np.arange(len(order))
                blobs = [np.array(lengths, np.int32), back.astype(np.int32)[flat], hashes[order], classes[order].astype(np.int16), counts[order]]
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("doc_id"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().hex]), ids, pa.array([held.tobytes()], pa.binary()), *(pa.array([b.tobytes()], pa.binary()) for b in blobs), pa.array([int(trains.sum())], pa.int64())],
                    names=["chunk", "ids", "held", "lengths", "tokens", "hashes", "classes", "counts", "n"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out("doc_id").alias("held"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = "chunk string, ids array<bigint>, held binary, lengths binary, tokens binary, hashes binary, classes binary, counts binary, n bigint"
    return rows.mapInArrow(work, schema)


def _store(df: DataFrame, tag: str) -> DataFrame:
    """Like ``materialize``, in row groups that hold few chunks each."""
    path = common.new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._weirflow_path = path
    return out


def _part_rows(part: np.ndarray, at: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    for p in np.unique(part):
        m = part == p
        yield int(p), at[m].astype(np.int64).tobytes(), values[m].astype(np.float64).tobytes()


def _summed(rows: DataFrame, width: int, spread: int = 1) -> dict[str, np.ndarray]:
    """Sums of value rows by place, over rows (part, at, sums); partial sums per task, then by part."""

    def lane(table: pa.Table) -> pa.Table:
        total = work(table)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "at": total.column("at"), "sums": total.column("sums")})

    def work(table: pa.Table) -> pa.Table:
        at = np.frombuffer(b"".join(table.column("at").to_pylist()), np.int64)
        values = np.frombuffer(b"".join(table.column("sums").to_pylist()), np.float64).reshape(-1, width)
        places, back = np.unique(at, return_inverse=True)
        total = np.stack([np.bincount(back, values[:, j], len(places)) for j in range(width)], 1)
        return pa.table({"at": pa.array([places.tobytes()], pa.binary()), "sums": pa.array([total.tobytes()], pa.binary())})

    # Two levels, so that a task sums what about the root of the number of tasks has sent.
    wide = max(1, math.isqrt(spread))
    rows = rows.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(wide)))
    first = rows.groupBy("part", "lane").applyInArrow(lane, "part int, at binary, sums binary")
    found = first.groupBy("part").applyInArrow(work, "at binary, sums binary").collect()
    at = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["at"], np.int64) for r in found)])
    values = np.concatenate([np.zeros((0, width)), *(np.frombuffer(r["sums"], np.float64).reshape(-1, width) for r in found)])
    return {"at": at, "sums": values}


def count_words(chunks: DataFrame, head_count: float) -> DataFrame:
    """Sums counts by word hash. Rows of kind 0 answer a chunk (its words' counts of one hash range),
    of kind 1 hold frequent words, of kind 2 a range's number of distinct words, of kind 3 class masses."""
    # As many ranges as chunks, so that what a task gathers does not grow with the corpus.
    parts = common.partitions_for(chunks, min(MOST_RANGES, chunks.count()))
    edges = (np.arange(1, parts, dtype=np.float64) / parts * 2.0**64).astype(np.uint64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, h, k, c in zip(*(batch.column(x).to_pylist() for x in ("chunk", "hashes", "classes", "counts")), strict=True):
                h, k, c = np.frombuffer(h, np.uint64), np.frombuffer(k, np.int16), np.frombuffer(c, np.int32)
                cuts = [0, *np.searchsorted(h, edges).tolist(), len(h)]
                at = [(p, a, b) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _, _ in at], pa.int32()), pa.array([chunk] * len(at)), *(pa.array([x[a:b].tobytes() for _, a, b in at], pa.binary()) for x in (h, k, c))],
                    names=["range", "chunk", "hashes", "classes", "counts"],
                )

    def total(table: pa.Table) -> pa.Table:
        h = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint64)
        k = np.frombuffer(b"".join(table.column("classes").to_pylist()), np.int16)
        c = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int32)
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        sums = np.rint(np.bincount(back, c)).astype(np.int64)
        ends = np.cumsum([len(x) // 8 for x in table.column("hashes").to_pylist()])[:-1]
        answers = [x.tobytes() for x in np.split(sums[back], ends)]
        frequent = (sums >= head_count) & (sums > 0)
        tail = ~frequent & (sums > 0)
        mass = np.bincount(k[first][tail], sums[tail] + 1.0, CLASSES)
        number = table.column("range")[0].as_py()
        rows = [(0, chunk, number, a, b"") for chunk, a in zip(table.column("chunk").to_pylist(), answers, strict=True)]
        rows.append((1, "", number, distinct[frequent].tobytes(), sums[frequent].tobytes()))
        rows.append((2, "", int((sums > 0).sum()), b"", b""))
        where = np.flatnonzero(mass)
        rows += [(3, "", p, at, values) for p, at, values in _part_rows(where % PARTS, where, mass[where][:, None])]
        names = ["kind", "chunk", "number", "x", "y"]
        return pa.table(dict(zip(names, (pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)), strict=True)))

    dealt = chunks.select("chunk", "hashes", "classes", "counts").mapInArrow(deal, "`range` int, chunk string, hashes binary, classes binary, counts binary")
    return common.materialize(dealt.groupBy("range").applyInArrow(total, "kind int, chunk string, number bigint, x binary, y binary"), "hmm-counts")


class Corpus:
    """What scores need of the whole corpus, all of bounded size."""

    def __init__(self, counts: DataFrame, tokens: int):
        self.tokens = tokens
        heads = counts.where("kind = 1").select("x", "y").collect()
        h = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["x"], np.uint64) for r in heads)])
        c = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["y"], np.int64) for r in heads)])
        order = np.argsort(h)
        self.heads, self.head_counts = h[order], c[order]
        self.distinct = counts.where("kind = 2").agg(F.sum("number")).first()[0] or 0
        found = _summed(counts.where("kind = 3").select(F.col("number").cast("int").alias("part"), F.col("x").alias("at"), F.col("y").alias("sums")), 1, common.partitions_for(counts))
        self.mass = np.ones(CLASSES)  # words never seen: one more of each class
        self.mass[found["at"]] += found["sums"][:, 0]
        own = np.concatenate([self.head_counts + 1.0, self.mass])
        self.prior = own / own.sum()

    def symbols(self, hashes: np.ndarray, classes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each word, and log10 of its share within the symbol."""
        at = np.searchsorted(self.heads, hashes)
        at = np.minimum(at, max(0, len(self.heads) - 1))
        head = self.heads[at] == hashes if len(self.heads) else np.zeros(len(hashes), bool)
        symbol = np.where(head, at, len(self.heads) + classes.astype(np.int64))
        share = np.where(head, 0.0, np.log10(counts + 1.0) - np.log10(self.mass[classes]))
        return symbol.astype(np.int32), share


def encode_chunks(chunks: DataFrame, counts: DataFrame, corpus: Corpus) -> DataFrame:
    """A row a chunk: ids, flags and lengths, symbols of all tokens, and by document its base score, the
    number of known tokens and the log10 of the words' shares within their symbols."""
    shared = chunks.sparkSession.sparkContext.broadcast(corpus)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        own = shared.value
        blob = lambda name, kind: np.frombuffer(left.column(name)[0].as_py(), kind)
        pieces = sorted(zip(right.column("number").to_pylist(), right.column("x").to_pylist(), strict=True))
        c = np.frombuffer(b"".join(x for _, x in pieces), np.int64)
        lengths, tokens = blob("lengths", np.int32), blob("tokens", np.int32)
        symbol, share = own.symbols(blob("hashes", np.uint64), blob("classes", np.int16), c)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        by_doc = lambda x: np.add.reduceat(x[tokens], starts)
        base = by_doc(np.log10(c + 1.0)) - lengths * np.log10(own.tokens + own.distinct + 1.0)
        out = {"chunk": left.column("chunk"), "ids": left.column("ids"), "held": left.column("held"), "lengths": left.column("lengths")}
        for name, x in (("symbols", symbol[tokens]), ("base", base), ("known", by_doc((c > 0).astype(np.int64))), ("shares", by_doc(share))):
            out[name] = pa.array([x.tobytes()], pa.binary())
        return pa.table(out)

    answers = counts.where("kind = 0").select("chunk", "number", "x")
    schema = "chunk string, ids array<bigint>, held binary, lengths binary, symbols binary, base binary, known binary, shares binary"
    return _store(chunks.drop("counts", "n").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(work, schema), "hmm-coded")


# -- the model


class Model:
    def __init__(self, start: np.ndarray, moves: np.ndarray, emissions: np.ndarray):
        self.start, self.moves, self.emissions = start, moves, emissions  # (K,), (K, K), (symbols, K)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)


class Layout:
    """Tokens of many documents by position: those of all documents that have a first, then a second one, ..."""

    def __init__(self, lengths: np.ndarray, starts: np.ndarray | None = None):
        self.order = np.argsort(-lengths, kind="stable")
        sizes = lengths[self.order].astype(np.int64)
        self.steps = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(self.steps), side="left") if self.steps else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(active)])
        starts = (_starts(lengths) if starts is None else starts)[self.order]
        rank = np.repeat(np.arange(len(sizes)), sizes)
        position = np.arange(int(sizes.sum())) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        self.active, self.offsets = active.tolist(), offsets.tolist()
        self.source = np.empty(len(position), np.int64)
        self.source[offsets[position] + rank] = np.repeat(starts, sizes) + position

    def by_document(self, values: np.ndarray) -> np.ndarray:
        """Sums of the tokens' values."""
        out = np.zeros(len(self.order))
        if self.steps:
            rank = np.arange(len(values)) - np.repeat(self.offsets[:-1], self.active)
            out[self.order] = np.bincount(rank, values, len(out))
        return out


def forward(model: Model, lengths: np.ndarray, symbols: np.ndarray, keep: bool = False, starts: np.ndarray | None = None):
    """log10 likelihood of each document; with ``keep`` that of all, and what the backward recursion needs.

    Arrays hold a row a state, so that all documents of a step are one vector.
    """
    layout = Layout(lengths, starts)
    own = symbols[layout.source]
    emitted = np.take(np.ascontiguousarray(model.emissions.T), own, axis=1)
    into_state = np.ascontiguousarray(model.moves.T)
    k, kind = len(model.start), emitted.dtype
    alphas = np.empty_like(emitted) if keep else None
    scale = np.empty(emitted.shape[1], kind)
    alpha, now = np.zeros((k, len(lengths)), kind), np.empty((k, len(lengths)), kind)
    for t in range(layout.steps):
        n, a = layout.active[t], layout.offsets[t]
        step, s = now[:, :n], scale[a : a + n]
        if t:
            np.matmul(into_state, alpha[:, :n], out=step)
            step *= emitted[:, a : a + n]
        else:
            np.multiply(model.start[:, None], emitted[:, :n], out=step)
        np.add.reduce(step, axis=0, out=s)
        alpha = alphas[:, a : a + n] if keep else alpha[:, :n]
        np.divide(step, s, out=alpha)
    if keep:
        return float(np.log(scale).sum(dtype=np.float64)) / math.log(10), layout, own, alphas, emitted, scale
    return layout.by_document(np.log10(scale, dtype=np.float64))


def expected(model: Model, lengths: np.ndarray, symbols: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions (places and rows of sums) of some documents, and their log10 likelihood."""
    k = len(model.start)
    log, layout, own, gamma, emitted, scale = forward(model, lengths, symbols, True, starts)
    moves = np.zeros((k, k))
    back = np.ones((k, len(lengths)), emitted.dtype)
    for t in range(layout.steps - 1, -1, -1):
        n, a = layout.active[t], layout.offsets[t]
        now = back[:, :n]
        gamma[:, a : a + n] *= now
        if t:
            w = emitted[:, a : a + n]
            w *= now
            w /= scale[a : a + n]
            b = layout.offsets[t - 1]
            moves += gamma[:, b : b + n] @ w.T  # still the forward values
            np.matmul(model.moves, w, out=now)
    moves *= model.moves
    sums = np.stack([np.bincount(own, gamma[j], len(model.emissions)) for j in range(k)], 1)
    places = np.flatnonzero(sums.any(1))
    return gamma[:, : layout.active[0]].sum(1, dtype=np.float64) if layout.steps else np.zeros(k), moves, places, sums[places], log


def by_length(lengths: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Documents of about the same length together, about ``most`` tokens: every document takes part in most steps of its batch."""
    order = np.argsort(-lengths, kind="stable")
    number = np.cumsum(lengths[order], dtype=np.int64) // most
    yield from np.split(order, np.flatnonzero(np.diff(number)) + 1)


def maximize(starts: np.ndarray, moves: np.ndarray, at: np.ndarray, sums: np.ndarray, corpus: Corpus) -> Model:
    k = len(starts)
    weight = max(PRIOR_LEAST, PRIOR_SHARE * corpus.tokens)
    emissions = np.repeat((weight * corpus.prior)[:, None], k, 1)
    emissions[at] += sums
    return Model((starts + 1) / (starts.sum() + k), (moves + 1) / (moves.sum(1, keepdims=True) + k), emissions / emissions.sum(0))


def starting_point(corpus: Corpus, states: int = STATES) -> Model:
    """A seeded perturbation of the corpus's distribution, with states that tend to stay."""
    rng = np.random.default_rng(4)
    emissions = corpus.prior[:, None] * rng.gamma(1.0, 1.0, (len(corpus.prior), states))
    moves = np.full((states, states), 0.02 / max(1, states - 1)) + np.eye(states) * 0.98
    return Model(np.full(states, 1 / states), moves / moves.sum(1, keepdims=True), emissions / emissions.sum(0))


def baum_welch(coded: DataFrame, model: Model, corpus: Corpus) -> tuple[Model, float]:
    """One round over all training documents; the new model, and the log10 likelihood under the old one."""
    # Probabilities of a step in single precision, at half the memory traffic; sums over steps and chunks in double.
    shared = coded.sparkSession.sparkContext.broadcast(Model(*(x.astype(np.float32) for x in (model.start, model.moves, model.emissions))))
    k = len(model.start)
    size = len(corpus.prior)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, moves, sums, log, any_ = np.zeros(k), np.zeros((k, k)), np.zeros((size, k)), 0.0, False
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held_back = 0

        def settle() -> None:
            nonlocal starts, moves, log, any_, held_back
            if not waiting:
                return
            lengths, begins, symbols = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            held_back = 0
            for docs in by_length(lengths, BATCH):
                s, m, at, e, one = expected(shared.value, lengths[docs], symbols, begins[docs])
                starts, moves, log, any_ = starts + s, moves + m, log + one, True
                sums[at] += e

        for batch in batches:
            for row in range(batch.num_rows):
                held, lengths, symbols = (np.frombuffer(batch.column(c)[row].as_buffer(), kind) for c, kind in (("held", bool), ("lengths", np.int32), ("symbols", np.int32)))
                if not held.all():
                    waiting.append((lengths[~held], _starts(lengths)[~held] + held_back, symbols))
                    held_back += len(symbols)
                if held_back >= WAITING:
                    settle()
        settle()
        if any_:
            at = np.flatnonzero(sums.any(1))
            rows = list(_part_rows(at % PARTS, at, sums[at]))
            # Behind the symbols: starts, moves by state, and the likelihood.
            extra = np.concatenate([starts[None], moves, np.full((1, k), log)])
            rows.append((0, np.arange(size, size + len(extra)).tobytes(), extra.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "at", "sums"])

    found = _summed(coded.select("held", "lengths", "symbols").mapInArrow(work, "part int, at binary, sums binary"), k, coded.rdd.getNumPartitions())
    if not len(found["at"]):
        return model, 0.0
    extra = np.zeros((k + 2, k))
    behind = found["at"] >= size
    extra[found["at"][behind] - size] = found["sums"][behind]
    return maximize(extra[0], extra[1 : k + 1], found["at"][~behind], found["sums"][~behind], corpus), float(extra[k + 1, 0])


def score(coded: DataFrame, model: Model, corpus: Corpus) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    shared = coded.sparkSession.sparkContext.broadcast(model)
    n = corpus.tokens

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                blob = lambda name, kind: np.frombuffer(batch.column(name)[k].as_py(), kind)  # noqa: B023, E731
                lengths = blob("lengths", np.int32)
                found = forward(shared.value, lengths, blob("symbols", np.int32)) + blob("shares", np.float64)
                columns = [batch.column("ids")[k].values, pa.array(blob("held", bool)), pa.array(lengths.astype(np.int64)), pa.array(blob("known", np.int64)), pa.array(np.full(len(lengths), n, np.int64)), pa.array(blob("base", np.float64)), pa.array(found)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return coded.mapInArrow(work, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def fit(docs: DataFrame, text: str = "text", states: int = STATES, rounds: int | None = None) -> tuple[DataFrame, Model, Corpus]:
    """The coded corpus, the model after so many rounds or as many as the likelihood takes to settle, and the corpus's counts."""
    chunks = _store(make_chunks(docs, text), "hmm-chunks")
    tokens = chunks.agg(F.sum("n")).first()[0] or 0
    counts = count_words(chunks, max(math.sqrt(tokens) / HEAD, tokens / MOST_SYMBOLS))
    corpus = Corpus(counts, tokens)
    coded = encode_chunks(chunks, counts, corpus)
    common.release(chunks)
    common.release(counts)
    model, before, still, done = starting_point(corpus, states), -math.inf, 0, 0
    while tokens and (still < STILL if rounds is None else done < rounds):
        model, log = baum_welch(coded, model, corpus)
        still = still + 1 if log - before < SETTLED * abs(log) else 0
        before, done = log, done + 1
    return coded, model, corpus


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of those that are not held out."""
    return score(*fit(common.documents(spark, sf_dir)))
