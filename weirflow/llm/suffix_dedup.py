"""Suffix-array dedup: removes bytes of 100-byte strings that start earlier, too.

Column-wise multi-document construction. The texts that can hold a repeat are cut into strings
aligned on content: each 100-byte window has an anchor, the leftmost least of its hashed
36-byte grams, so equal windows have equal anchors at equal distances. Every anchor that occurs
again gives one string of 164 bytes, in which all windows of that anchor lie. Strings are
grouped by anchor, and the groups' suffixes are sorted together from the last column to the
first: each round inserts one symbol per string in front of its suffix, takes the new order from
the ranks of the symbols in the current Burrows-Wheeler column (its symbol's first place plus
its rank among equal symbols, group by group), and updates the common prefixes of neighbours: one
more than the least between their old places where symbols agree, else none. Columns, order,
Burrows-Wheeler column and prefixes are sequential files that each round reads and writes once,
under a name of their own: a file that is written over is flushed to disk before the next round.
Because windows that can be equal share a column, a round needs the previous column's files only,
and the cost is one pass over the strings instead of one a round over all suffixes so far. In the
columns where windows begin, neighbours with a common prefix of 100 bytes or more are equal
windows; all but the earliest are marked.

Data flow: texts are written once in row groups ("units") to the shared folder; no text is
shuffled. A unit's repeats within itself are settled first, so that an anchor leaves a unit once
per different string however often it occurs there; exact copies of whole texts are settled by
digest before that. Anchors are dealt by hash to as many ranges as there are units, those met in one
place only are dropped, and only strings around the others move. Strings of an anchor that is met
very often go by the bytes around it as well, which equal windows share, so they are many groups.
Columns' files are in the shared folder, below one path a query.

Defined cases: a null text is empty; texts under 100 bytes lose nothing; equal ids are ordered by
their place in the written table; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm import common

#: Bytes of a window, of a gram, and grams of a window.
SPAN, GRAM = 100, 36
GRAMS = SPAN - GRAM + 1
#: Bytes of a string around an anchor, and where the anchor stands in it.
WIDTH, CENTRE = GRAMS - 1 + SPAN, GRAMS - 1
#: Text bytes hashed together, strings sorted together, and bytes of a unit.
PIECE, TOGETHER, UNIT = 1 << 20, 1 << 15, 8 << 20
#: An anchor with more strings than this is split: by ``STRIDE`` distances at a time and the bytes that their windows share.
HOT, STRIDE = 4096, 5
#: Most tasks over units.
MOST_TASKS = 100_000

_B = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: What travels: an anchor (where it is, its windows' distances), and the same with its string.
ANCHOR = np.dtype([("hash", "<u8"), ("row", "<i4"), ("at", "<i4"), ("lo", "u1"), ("hi", "u1")])
STRING = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("row", "<i4"), ("at", "<i4"), ("lo", "u1"), ("hi", "u1"), ("text", "u1", (WIDTH,))])
#: Windows of a row that start at ``first`` to ``last`` are repeats.
MARK = np.dtype([("row", "<i4"), ("first", "<i4"), ("last", "<i4")])
WHOLE = np.dtype([("hash", "<u8"), ("more", "<u8"), ("doc", "<i8"), ("row", "<i4")])


# -- anchors


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << (n - 1).bit_length())
    if size not in _powers:
        inverse = pow(_B, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up = np.concatenate([[np.uint64(1)], np.full(size, _B & (2**64 - 1), np.uint64)])
            down = np.concatenate([[np.uint64(1)], np.full(size, inverse, np.uint64)])
            _powers.clear()
            _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM consecutive bytes."""
    up, down = _power_table(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def window_anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``data``: where its anchor begins, and the anchor's hash."""
    h = gram_hashes(data)
    value, place = h, np.arange(len(h), dtype=np.int32)
    width = 1
    while width < GRAMS:
        step = min(width, GRAMS - width)
        later = value[step:] < value[:-step]  # the earlier one where they are equal
        value = np.where(later, value[step:], value[:-step])
        place = np.where(later, place[step:], place[:-step])
        width += step
    return place, value


def unit_anchors(texts: list[bytes], rows: list[int]) -> np.ndarray:
    """Anchors of all windows of the texts that are given by ``rows``."""
    found = [np.zeros(0, ANCHOR)]
    pieces: list[tuple[int, int, bytes]] = []
    held = 0

    def settle() -> None:
        nonlocal held
        if not pieces:
            return
        data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
        place, value = window_anchors(data)
        sizes = np.array([len(p) for _, _, p in pieces])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        which = np.repeat(np.arange(len(pieces)), sizes)[: len(place)]
        window = np.arange(len(place))
        inside = window + SPAN <= (starts + sizes)[which]
        window, place, value, which = window[inside], place[inside], value[inside], which[inside]
        if len(window):
            new = np.concatenate([[True], (place[1:] != place[:-1]) | (which[1:] != which[:-1])])
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(window)]]) - 1
            out = np.zeros(len(first), ANCHOR)
            out["hash"] = value[first]
            out["row"] = np.array([r for r, _, _ in pieces])[which[first]]
            out["at"] = place[first] - starts[which[first]] + np.array([o for _, o, _ in pieces])[which[first]]
            out["lo"], out["hi"] = place[first] - window[last], place[first] - window[first]
            found.append(out)
        pieces.clear()
        held = 0

    for row in rows:
        text = texts[row]
        for offset in range(0, max(1, len(text) - SPAN + 1), PIECE):
            part = text[offset : offset + PIECE + SPAN - 1]
            if len(part) >= SPAN:
                pieces.append((row, offset, part))
                held += len(part)
                if held >= PIECE:
                    settle()
    settle()
    return np.concatenate(found)


def repeated(anchors: np.ndarray) -> np.ndarray:
    """Those whose hash occurs more than once, by hash."""
    by = anchors[np.argsort(anchors["hash"], kind="stable")]
    if not len(by):
        return by
    same = by["hash"][1:] == by["hash"][:-1]
    return by[np.concatenate([[False], same]) | np.concatenate([same, [False]])]


def strings_of(anchors: np.ndarray, texts: list[bytes], doc_ids: np.ndarray) -> np.ndarray:
    """The anchors with the bytes around them; bytes outside the text are zero and in no window."""
    out = np.zeros(len(anchors), STRING)
    for name in ANCHOR.names:
        out[name] = anchors[name]
    out["doc"] = doc_ids[anchors["row"]]
    if not len(anchors):
        return out
    order = np.argsort(anchors["row"], kind="stable")
    rows, firsts = np.unique(anchors["row"][order], return_index=True)
    for row, mine in zip(rows.tolist(), np.split(order, firsts[1:]), strict=True):
        padded = np.frombuffer(b"\0" * CENTRE + texts[row] + b"\0" * SPAN, np.uint8)
        views = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)
        out["text"][mine] = views[anchors["at"][mine]]
    return out


# -- column-wise construction


class ColumnFiles:
    """Sequential files of one construction, in a folder of their own below ``root`` that is removed at its end; without ``root`` in memory.

    The symbols are one file, and each column's order, Burrows-Wheeler column and prefixes another, which goes when the next is written.
    """

    def __init__(self, text: np.ndarray, root: str | None):
        self.rows, self.last = len(text), None
        self.store = None
        symbols = np.ascontiguousarray(text.T)
        if not root:
            self.symbols = symbols
            return
        self.store, inner = fs.FileSystem.from_uri(root)
        self.folder = f"{inner}/columns-{uuid.uuid4().hex}"
        self.store.create_dir(self.folder)
        with self.store.open_output_stream(f"{self.folder}/symbols") as f:
            f.write(symbols)

    def symbols_of(self, j: int) -> np.ndarray:
        if not self.store:
            return self.symbols[j]
        with self.store.open_input_file(f"{self.folder}/symbols") as f:
            return np.frombuffer(f.read_at(self.rows, j * self.rows), np.uint8)

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        """Order and prefixes of the last column."""
        if not self.store:
            return self.last
        with self.store.open_input_stream(self.last) as f:
            data, m = f.read(), self.rows
        return np.frombuffer(data, np.int32, m), np.frombuffer(data, np.uint8, m, 5 * m)

    def write(self, j: int, order: np.ndarray, bwt: np.ndarray, prefixes: np.ndarray) -> None:
        if not self.store:
            self.last = order, prefixes
            return
        before, self.last = self.last, f"{self.folder}/column-{j}"
        with self.store.open_output_stream(self.last) as f:
            for values in (order, bwt, prefixes):
                f.write(values)
        if before:
            self.store.delete_file(before)

    def remove(self) -> None:
        if self.store:
            self.store.delete_dir(self.folder)


def _range_minimum(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of ``values[first .. last]`` for each pair, by a table of powers of two."""
    length = last - first + 1
    level = np.frexp(length.astype(np.float64))[1] - 1
    out = np.empty(len(first), values.dtype)
    table, k = values, 0
    top = int(level.max()) if len(level) else -1
    while k <= top:
        m = np.flatnonzero(level == k)
        out[m] = np.minimum(table[first[m]], table[last[m] - (1 << k) + 1])
        if k < top:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
        k += 1
    return out


def columns(text: np.ndarray, group: np.ndarray, root: str | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sorts all suffixes of equally long strings, group by group, one column after the other from the last.

    Yields each column with the order of the suffixes that begin there and the common prefix of
    each with the one before (0 at the beginning of a group). ``group`` holds non-negative numbers.
    """
    files = ColumnFiles(text, root)
    try:
        m = len(group)
        order = np.argsort(group, kind="stable")
        _, sizes = np.unique(group, return_counts=True)
        number = np.repeat(np.arange(len(sizes)), sizes)  # of the group at each place; places of a group stay together
        begins = np.concatenate([[True], number[1:] != number[:-1]]) if m else np.zeros(0, bool)
        files.write(text.shape[1], order.astype(np.int32), np.zeros(m, np.uint8), np.zeros(m, np.uint8))
        for j in range(text.shape[1] - 1, -1, -1):
            order, prefixes = files.read()
            bwt = files.symbols_of(j)[order]  # the symbol before each suffix, in the suffixes' order
            place = np.argsort(number * 256 + bwt, kind="stable")  # new places: by group, symbol, old place
            symbol = bwt[place]
            agree = np.concatenate([[False], symbol[1:] == symbol[:-1]]) & ~begins
            where = np.flatnonzero(agree)
            longer = np.zeros(m, np.uint8)
            if len(where):
                longer[where] = np.minimum(_range_minimum(prefixes, place[where - 1] + 1, place[where]), 254) + 1
            order = order[place]
            files.write(j, order, bwt, longer)
            yield j, order, longer
    finally:
        files.remove()


def mark_repeats(strings: np.ndarray, unit: np.ndarray, root: str | None = None) -> np.ndarray:
    """For each string a row of GRAMS flags: whether the window at that distance before the anchor is a repeat."""
    marked = np.zeros((len(strings), GRAMS), bool)
    if not len(strings):
        return marked
    # The earliest of equal windows: by document, unit, row and start; at one distance, by the anchor.
    rank = np.empty(len(strings), np.int64)
    rank[np.lexsort((strings["at"], strings["row"], unit, strings["doc"]))] = np.arange(len(strings))
    _, group = np.unique(strings["hash"], return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(np.bincount(group))])
    by_group = np.argsort(group, kind="stable")
    a = 0
    while a < len(ends) - 1:  # whole groups, some strings together
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + TOGETHER, side="right")) - 1)
        part = by_group[ends[a] : ends[b]]
        for j, order, prefixes in columns(strings["text"][part], group[part], root):
            distance = CENTRE - j
            if distance < 0:
                continue
            chosen = part[order]
            new = prefixes < SPAN
            number = np.cumsum(new) - 1
            valid = (strings["lo"][chosen] <= distance) & (distance <= strings["hi"][chosen])
            if not valid.any():
                continue
            number, chosen = number[valid], chosen[valid]
            first = np.full(int(number[-1]) + 1, np.iinfo(np.int64).max)
            np.minimum.at(first, number, rank[chosen])
            marked[chosen[rank[chosen] > first[number]], distance] = True
        a = b
    return marked


def split_by_context(strings: np.ndarray) -> np.ndarray:
    """The strings once for each ``STRIDE`` distances that they have windows at; the hash tells apart the bytes these windows share."""
    found = [strings[:0]]
    for a in range(0, GRAMS, STRIDE):
        b = min(a + STRIDE, GRAMS) - 1
        part = strings[(strings["lo"] <= b) & (strings["hi"] >= a)].copy()
        part["lo"], part["hi"] = np.maximum(part["lo"], a), np.minimum(part["hi"], b)
        common_bytes = part["text"][:, CENTRE - a : CENTRE - b + SPAN].astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            up = np.multiply.accumulate(np.full(common_bytes.shape[1], _B & (2**64 - 1), np.uint64))
            h = part["hash"] ^ (common_bytes * up).sum(1, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(a)
        part["hash"] = h ^ (h >> np.uint64(29))
        found.append(part)
    return np.concatenate(found)


def marks_of(strings: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Runs of marked windows."""
    wide = np.zeros((len(marked), GRAMS + 2), np.int8)
    wide[:, 1:-1] = marked
    change = np.diff(wide, axis=1)
    s, lo = np.nonzero(change == 1)
    _, hi = np.nonzero(change == -1)
    out = np.zeros(len(s), MARK)
    out["row"], out["first"], out["last"] = strings["row"][s], strings["at"][s] - (hi - 1), strings["at"][s] - lo
    return out


# -- units and the exchange between them


def write_units(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame, str]:
    """Texts in row groups of about ``UNIT`` bytes; one row (unit, path, group) for each."""
    spark = docs.sparkSession
    path = common.new_path(spark, "suffix-texts")
    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    out.write.option("compression", "zstd").option("parquet.block.size", UNIT).option("parquet.page.size.row.check.min", 10).parquet(path)
    files = sorted(spark.read.parquet(path).inputFiles())
    listed = spark.createDataFrame(list(enumerate(files)), "file bigint, path string").repartition(max(1, min(len(files), 4096)), "file")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, name in zip(batch.column("file").to_pylist(), batch.column("path").to_pylist(), strict=True):
                store, inner = fs.FileSystem.from_uri(name)
                with store.open_input_file(inner) as f:
                    n = pq.ParquetFile(f).num_row_groups
                rows += [(file * 65536 + g, name, g) for g in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int32()))], names=["unit", "path", "group"])

    units = common.materialize(listed.mapInArrow(groups, "unit bigint, path string, `group` int"), "suffix-units")
    return units, path


def read_unit(path: str, group: int) -> tuple[np.ndarray, list[bytes], list]:
    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_file(inner) as f:
        table = pq.ParquetFile(f).read_row_group(group)
    ids = table.column("doc_id").to_pylist()
    return np.array([-(2**63) if i is None else i for i in ids], np.int64), table.column("text").to_pylist(), ids


_SCHEMA = "dest bigint, unit bigint, kind string, data binary"
_NAMES = ["dest", "unit", "kind", "data"]


def _rows(rows: list[tuple[int, int, str, bytes]]) -> pa.Table:
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(_NAMES, (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))})


def _deal(values: np.ndarray, parts: int, unit: int, kind: str) -> list[tuple[int, int, str, bytes]]:
    """Values by the range of their mixed hash."""
    if not len(values):
        return []
    mixed = values["hash"] * np.uint64(0x9E3779B97F4A7C15)  # anchors are least hashes: most are small
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    dest = (mixed >> np.uint64(32)).astype(np.int64) * parts >> 32
    order = np.argsort(dest, kind="stable")
    found, firsts = np.unique(dest[order], return_index=True)
    return [(int(d), unit, kind, values[i].tobytes()) for d, i in zip(found, np.split(order, firsts[1:]), strict=True)]


def _of(table: pa.Table, kind: str, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a kind, and the unit of each."""
    rows = [(d, u) for k, d, u in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), table.column("unit").to_pylist(), strict=True) if k == kind]
    values = np.frombuffer(b"".join(d for d, _ in rows), dtype)
    return values, np.repeat(np.array([u for _, u in rows], np.int64), [len(d) // dtype.itemsize for d, _ in rows])


def _by_unit(values: np.ndarray, unit: np.ndarray, kind: str) -> list[tuple[int, int, str, bytes]]:
    if not len(values):
        return []
    order = np.argsort(unit, kind="stable")
    found, firsts = np.unique(unit[order], return_index=True)
    return [(-1, int(u), kind, values[i].tobytes()) for u, i in zip(found, np.split(order, firsts[1:]), strict=True)]


def _each_unit(units: DataFrame, news: DataFrame | None, work: Callable[[int, str, int, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work(unit, path, group, news of the unit)`` for every unit."""
    if news is None:
        news = units.sparkSession.createDataFrame([], _SCHEMA)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return work(left.column("unit")[0].as_py(), left.column("path")[0].as_py(), left.column("group")[0].as_py(), right)

    # A unit's row is small and its work is not: as many tasks as units, whatever the rows weigh.
    tasks = min(MOST_TASKS, 2 * units.count() + 1)
    by_unit = lambda df: df.repartition(tasks, "unit").groupBy("unit")
    return by_unit(units).cogroup(by_unit(news)).applyInArrow(run, schema)


def duplicated_spans(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame, str]:
    """Units, and for each unit its rows of kinds ``copy`` (whole texts) and ``mark`` (windows) that are repeats."""
    units, path = write_units(docs, text)
    parts = common.partitions_for(docs, min(MOST_TASKS, units.count()))  # a range weighs about what a unit does
    root = common.new_path(docs.sparkSession, "suffix-columns")

    def whole(unit: int, path: str, group: int, _: pa.Table) -> pa.Table:
        ids, texts, _ = read_unit(path, group)
        long = [r for r, t in enumerate(texts) if len(t) >= SPAN]
        out = np.zeros(len(long), WHOLE)
        digests = np.frombuffer(b"".join(hashlib.blake2b(texts[r], digest_size=16).digest() for r in long), "<u8").reshape(-1, 2)
        out["hash"], out["more"], out["doc"], out["row"] = digests[:, 0], digests[:, 1], ids[long], long
        out = out[np.lexsort((out["row"], out["doc"], out["more"], out["hash"]))]
        copy = np.concatenate([[False], (out["hash"][1:] == out["hash"][:-1]) & (out["more"][1:] == out["more"][:-1])]) if len(out) else np.zeros(0, bool)
        rows = [(unit, unit, "copy", out["row"][copy].astype("<i4").tobytes())] if copy.any() else []
        return _rows(rows + _deal(out[~copy], parts, unit, "whole"))

    def same_whole(table: pa.Table) -> pa.Table:
        rows = [(-1, u, "copy", d) for k, u, d in zip(table.column("kind").to_pylist(), table.column("unit").to_pylist(), table.column("data").to_pylist(), strict=True) if k == "copy"]
        values, unit = _of(table, "whole", WHOLE)
        order = np.lexsort((values["row"], unit, values["doc"], values["more"], values["hash"]))
        values, unit = values[order], unit[order]
        copy = np.concatenate([[False], (values["hash"][1:] == values["hash"][:-1]) & (values["more"][1:] == values["more"][:-1])]) if len(values) else np.zeros(0, bool)
        return _rows(rows + _by_unit(values["row"][copy].astype("<i4"), unit[copy], "copy"))

    def local(unit: int, path: str, group: int, news: pa.Table) -> pa.Table:
        ids, texts, _ = read_unit(path, group)
        copies, _ = _of(news, "copy", np.dtype("<i4"))
        gone = set(copies.tolist())
        anchors = unit_anchors(texts, [r for r, t in enumerate(texts) if len(t) >= SPAN and r not in gone])
        twice = repeated(anchors)
        rows = [(unit, unit, "copy", copies.tobytes())] if len(copies) else []
        if len(twice):
            strings = strings_of(twice, texts, ids)
            marked = mark_repeats(strings, np.zeros(len(strings), np.int64), root)
            rows.append((unit, unit, "mark", marks_of(strings, marked).tobytes()))
            # Only windows that are not settled go on: the stretch of distances that holds them.
            distance = np.arange(GRAMS)
            open_ = ~marked & (twice["lo"][:, None] <= distance) & (distance <= twice["hi"][:, None])
            some = open_.any(1)
            rest = twice[some].copy()
            rest["lo"], rest["hi"] = open_[some].argmax(1), GRAMS - 1 - open_[some][:, ::-1].argmax(1)
            by = np.sort(anchors["hash"])
            once = ~np.isin(anchors["hash"], by[1:][by[1:] == by[:-1]])
            anchors = np.concatenate([anchors[once], rest])
        return _rows(rows + _deal(anchors, parts, unit, "anchor"))

    def met_again(table: pa.Table) -> pa.Table:
        rows = [(-1, u, k, d) for k, u, d in zip(table.column("kind").to_pylist(), table.column("unit").to_pylist(), table.column("data").to_pylist(), strict=True) if k != "anchor"]
        values, unit = _of(table, "anchor", ANCHOR)
        order = np.argsort(values["hash"], kind="stable")
        values, unit = values[order], unit[order]
        if len(values):
            # A hash that comes from one unit alone is settled there.
            new = np.concatenate([[True], values["hash"][1:] != values["hash"][:-1]])
            number = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            several = (np.minimum.reduceat(unit, first) != np.maximum.reduceat(unit, first))[number]
            hot = (np.bincount(number) > HOT)[number]
            for kind, use in (("anchor", several & ~hot), ("hot", several & hot)):
                rows += _by_unit(values[use], unit[use], kind)
        return _rows(rows)

    def strings(unit: int, path: str, group: int, news: pa.Table) -> pa.Table:
        keep = [(unit, unit, k, d) for k, d in zip(news.column("kind").to_pylist(), news.column("data").to_pylist(), strict=True) if k not in ("anchor", "hot")]
        anchors, hot = (_of(news, kind, ANCHOR)[0] for kind in ("anchor", "hot"))
        if len(anchors) or len(hot):
            ids, texts, _ = read_unit(path, group)
            keep += _deal(np.concatenate([strings_of(anchors, texts, ids), split_by_context(strings_of(hot, texts, ids))]), parts, unit, "string")
        return _rows(keep)

    def construct(table: pa.Table) -> pa.Table:
        rows = [(-1, u, k, d) for k, u, d in zip(table.column("kind").to_pylist(), table.column("unit").to_pylist(), table.column("data").to_pylist(), strict=True) if k != "string"]
        values, unit = _of(table, "string", STRING)
        marked = mark_repeats(values, unit, root)
        for u in np.unique(unit):
            own = unit == u
            marks = marks_of(values[own], marked[own])
            if len(marks):
                rows.append((-1, int(u), "mark", marks.tobytes()))
        return _rows(rows)

    # ``dest`` of news that a unit keeps is the unit: any task may hand them on.
    spread = lambda df: df.withColumn("dest", F.when(F.col("kind").isin("copy", "mark"), F.pmod("dest", F.lit(parts))).otherwise(F.col("dest")))
    exchange = lambda df, work: spread(df).repartition(parts, "dest").groupBy("dest").applyInArrow(work, _SCHEMA)
    copies = common.materialize(exchange(_each_unit(units, None, whole, _SCHEMA), same_whole), "suffix-copies")
    again = common.materialize(exchange(_each_unit(units, copies, local, _SCHEMA), met_again), "suffix-anchors")
    common.release(copies)
    return units, exchange(_each_unit(units, again, strings, _SCHEMA), construct), path


def remove_repeats(docs: DataFrame, text: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` the kept bytes, of every document."""
    units, news, _ = duplicated_spans(docs, text)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text

    def finish(unit: int, path: str, group: int, news: pa.Table) -> pa.Table:
        _, texts, ids = read_unit(path, group)
        copies = set(_of(news, "copy", np.dtype("<i4"))[0].tolist())
        marks, _ = _of(news, "mark", MARK)
        marks = marks[np.lexsort((marks["first"], marks["row"]))]
        rows, firsts = np.unique(marks["row"], return_index=True)
        of_row = dict(zip(rows.tolist(), np.split(marks, firsts[1:]), strict=True)) if len(marks) else {}
        removed, spans, kept = [], [], []
        for r, t in enumerate(texts):
            if r in copies:
                removed.append(len(t))
                spans.append(1)
                kept.append(b"")
                continue
            own = of_row.get(r)
            if own is None:
                removed.append(0)
                spans.append(0)
                kept.append(t)
                continue
            begin, end = own["first"].astype(np.int64), np.maximum.accumulate(own["last"].astype(np.int64) + SPAN)
            new = np.concatenate([[True], begin[1:] > end[:-1]])
            begin, end = begin[new], np.concatenate([end[:-1][new[1:]], end[-1:]])
            removed.append(int((end - begin).sum()))
            spans.append(len(begin))
            kept.append(b"".join(t[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(t)], strict=True)))
        out = {"doc_id": pa.array(ids, pa.int64()), "n_bytes": [len(t) for t in texts], "n_removed": removed, "n_spans": spans, "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}
        out = {k: v if isinstance(v, pa.Array) else pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()}
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    return _each_unit(units, news, finish, schema)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What stays of every document without the bytes of repeated 100-byte strings."""
    return remove_repeats(common.documents(spark, sf_dir), with_text=False)
