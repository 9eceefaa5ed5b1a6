"""Secret scans with DataFrame functions only: fixed patterns, then windows of high entropy.

Base spans are the leftmost non-overlapping matches of three patterns (``assign``, ``access``,
``hex``). The method adds ``entropy`` spans: a candidate is a stretch of 20 or more characters
``[A-Za-z0-9+/_=-]`` outside all base spans; its character class is hex, mixed (letters with digits) or letters; a
window of 20 characters slides over it, and the counts of its characters change by one in and
one out a step, and with them the sum of ``c log2 c`` from which Shannon's entropy follows.
Windows that reach the class's threshold make one span from the first such window's start to
the last one's end. Candidates on the allow-list are left out.

Work is linear in a text's length and in the length and number of its matches, but for lists that
grow block by block: no pattern recurses or tracks back, places in a candidate are read from its
bytes, and passes over matches keep what they emit in blocks of ``BLOCK``.

All columns come from one narrow pass: no shuffle, no Python. A null text is empty, an empty
text has no spans (and the digest of the empty string). Positions are code points, ends exclusive.
Rows are independent, so ties and repeated rows need no rule. Extra columns are carried by ``keep``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: kind -> pattern, the group whose length counts, least length
BASE = {"assign": (ASSIGN, 1, 6), "access": (ACCESS, 0, 20), "hex": (HEX, 0, 24)}
#: A run of ``HEX`` or ``ACCESS`` that is long enough; where none is, the slower split is not needed.
PRESENT = {"access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits a character that a window must reach, by character class.
THRESHOLDS = {"hex": 3.0, "mixed": 3.6, "letters": 3.6}
#: Candidates that match one of these wholly are no secrets: numbers and dates, names made of
#: words or of words with short numbers, names whose words begin with capitals, and universally
#: unique identifiers.
#: Repeated groups are possessive (each has one way to match): others take a frame of the stack a repetition.
ALLOWED = (
    r"[0-9+/_=-]+",
    r"(?:[A-Za-z]{0,18}+[0-9]{0,4}+[_/=+-]++)++[A-Za-z]{0,18}+[0-9]{0,4}+",
    r"[_/=+-]*+[A-Z]?[a-z]{1,17}+(?:[_/=+-]*+[A-Z][a-z]{1,17}+)++[_/=+-]*+",
    r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}",
)
#: Matches that a pass takes at a time, and windows of a candidate.
BLOCK, STEPS = 512, 1 << 15
_RUNS = "array<struct<match:string,start:int,end:int>>"
_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pass(items: Column, state: Column, step, emits: str) -> Column:
    """What ``step(state, item) -> (state, array)`` emits from left to right, in one array of type ``emits``."""
    empty = F.array().cast(emits)

    def one(acc: Column, x: Column) -> Column:
        after, emitted = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["part"], emitted).alias("part"))

    def run(all_items: Column) -> Column:
        def block(acc: Column, at: Column) -> Column:
            inner = F.struct(acc["state"].alias("state"), empty.alias("part"))
            return F.aggregate(F.slice(all_items, at, F.lit(BLOCK)), inner, one, lambda done: F.struct(done["state"].alias("state"), F.concat(acc["found"], done["part"]).alias("found")))

        begins = F.sequence(F.lit(1), F.size(all_items), F.lit(BLOCK))
        found = F.aggregate(begins, F.struct(state.alias("state"), empty.alias("found")), block, lambda done: done["found"])
        return F.when(F.size(all_items) > 0, found).otherwise(empty)

    return _let(items, run)


def _located(text: Column, pattern: str) -> Column:
    """``array<struct<match, start, end>>`` of all matches: the text between matches gives their places."""
    between = F.transform(F.split(text, pattern, -1), F.length)
    pairs = _let(between, lambda gaps: F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.slice(gaps, 1, F.size(gaps) - 1).alias("gap")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        end = start + F.length(x["match"])
        return end, F.array(F.struct(x["match"].alias("match"), start.alias("start"), end.alias("end")))

    return _pass(pairs, F.lit(0), step, _RUNS)


def _base(kind: str, rank: int) -> Column:
    pattern, group, least = BASE[kind]
    text = F.col("__text")

    def enough(x: Column) -> Column:
        value = x["match"] if group == 0 else F.regexp_extract(x["match"], pattern, group)
        return F.length(value) >= least

    spans = F.transform(F.filter(_located(text, pattern if kind == "assign" else PRESENT[kind] + (r"[A-Z0-9]*" if kind == "access" else "[0-9a-f]*")), enough), lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.when(text.rlike(PRESENT.get(kind, pattern)), spans).otherwise(F.array().cast(_SPANS))


def window_entropy(candidate: Column, threshold: Column, window: int = WINDOW) -> Column:
    """``struct<best, first, last>``: the largest entropy of a window, and where windows at the threshold begin.

    ``first`` is -1 where no window reaches it. ``candidate`` and ``threshold`` are read at every
    step and should be columns or variables; the candidate is ASCII, as bytes. Counts stand in a
    string, one character a symbol, and are carried from window to window: a step changes the
    entering and the leaving one.
    """
    zero = "@"  # a count c is the character of code 64 + c
    n_log_n = lambda c: F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    symbol = lambda i: F.ascii(F.substring(candidate, i, F.lit(1)).cast("string"))
    count = lambda counts, c: F.ascii(F.substring(counts, c, F.lit(1))) - ord(zero)
    put = lambda counts, c, n: F.overlay(counts, F.chr((n + ord(zero)).cast("bigint")), c, F.lit(1))
    start = F.struct(F.lit(zero * 128).alias("counts"), F.lit(0.0).alias("total"), F.lit(-1.0).alias("best"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(acc: Column, i: Column) -> Column:
        def leave(now: Column) -> Column:
            """Without the symbol that falls out of the window."""
            n = count(acc["counts"], now["out"])
            counts = F.when(now["out"] > 0, put(acc["counts"], now["out"], n - 1)).otherwise(acc["counts"])
            total = F.when(now["out"] > 0, acc["total"] + n_log_n(n - 1) - n_log_n(n)).otherwise(acc["total"])
            return F.struct(now["in"].alias("in"), counts.alias("counts"), total.alias("total"))

        def enter(now: Column) -> Column:
            n = count(now["counts"], now["in"])
            return F.struct(put(now["counts"], now["in"], n + 1).alias("counts"), (now["total"] + n_log_n(n + 1) - n_log_n(n)).alias("total"))

        def judge(now: Column) -> Column:
            entropy = F.when(i >= window, F.lit(math.log2(window)) - now["total"] / window).otherwise(F.lit(-1.0))
            hit = entropy >= threshold - 1e-9
            return F.struct(
                now["counts"].alias("counts"),
                now["total"].alias("total"),
                F.greatest(acc["best"], entropy).alias("best"),
                F.when(hit & (acc["first"] < 0), i - window).otherwise(acc["first"]).alias("first"),
                F.when(hit, i - window).otherwise(acc["last"]).alias("last"),
            )

        moving = F.struct(symbol(i).alias("in"), F.when(i > window, symbol(i - window)).otherwise(F.lit(0)).alias("out"))
        return _let(_let(_let(moving, leave), enter), judge)

    n = F.length(candidate)
    steps = lambda acc, at: F.aggregate(F.sequence(at, F.least(at + (STEPS - 1), n)), acc, step)
    return F.aggregate(F.sequence(F.lit(1), n, F.lit(STEPS)), start, steps, lambda acc: F.struct(acc["best"].alias("best"), acc["first"].alias("first"), acc["last"].alias("last")))


def _outside(runs: Column, base: Column) -> Column:
    """The stretches of all runs that no base span covers, as ``_located`` gives runs; both are sorted by start.

    One pass over runs and base spans together: the state is the run that is open, as bytes (runs
    are ASCII), where it begins and ends, and up to where runs are covered or given out.
    """
    nothing = F.lit(None).cast("binary")
    event = lambda start, rank, end, run: F.struct(start.alias("start"), rank.alias("rank"), end.alias("end"), run.alias("run"))
    of_runs = F.transform(runs, lambda x: event(x["start"], F.lit(1), x["end"], x["match"].cast("binary")))
    of_base = F.transform(base, lambda b: event(b["start"], F.lit(0), b["end"], nothing))
    end = F.lit(2**31 - 1)
    events = F.array_sort(F.concat(of_runs, of_base, F.array(event(end, F.lit(0), end, nothing))))  # the last one closes the last run

    def step(state: Column, e: Column) -> tuple[Column, Column]:
        is_run = e["run"].isNotNull()
        # A base span cuts the open run where the span begins; a new run finds the old one behind it.
        stop = F.least(e["start"], state["end"])
        piece = F.struct(F.substring(state["run"], state["at"] - state["start"] + 1, stop - state["at"]).cast("string").alias("match"), state["at"].alias("start"), stop.alias("end"))
        emitted = F.when(stop - state["at"] >= WINDOW, F.array(piece)).otherwise(F.array().cast(_RUNS))
        after = F.struct(
            F.when(is_run, e["run"]).otherwise(state["run"]).alias("run"),
            F.when(is_run, e["start"]).otherwise(state["start"]).alias("start"),
            F.when(is_run, e["end"]).otherwise(state["end"]).alias("end"),
            F.when(is_run, F.greatest(e["start"], state["covered"])).otherwise(F.greatest(state["at"], e["end"])).alias("at"),
            F.when(is_run, state["covered"]).otherwise(F.greatest(state["covered"], e["end"])).alias("covered"),
        )
        return after, emitted

    begin = F.struct(nothing.alias("run"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("at"), F.lit(0).alias("covered"))
    return F.when(F.size(base) > 0, _pass(events, begin, step, _RUNS)).otherwise(runs)


def _entropy(rank: int, thresholds: dict[str, float], allowed: tuple[str, ...]) -> Column:
    text = F.col("__text")
    allow = "^(?:" + "|".join(allowed) + ")$" if allowed else "^(?!)$"
    kept = F.filter(_let(_located(text, CANDIDATE), lambda runs: _outside(runs, F.col("__base"))), lambda x: ~x["match"].rlike(allow))

    def classed(x: Column) -> Column:
        threshold = (
            F.when(x["match"].rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit(thresholds["hex"]))
            .when(x["match"].rlike("[0-9]") & x["match"].rlike("[A-Za-z]"), F.lit(thresholds["mixed"]))
            .otherwise(F.lit(thresholds["letters"]))
        )
        return F.struct(x["match"].cast("binary").alias("raw"), x["start"].alias("start"), threshold.alias("threshold"))

    def scored(x: Column) -> Column:
        span = lambda found: F.struct((x["start"] + found["first"]).alias("start"), F.lit(rank).alias("rank"), F.when(found["first"] >= 0, x["start"] + found["last"] + WINDOW).alias("end"), F.lit("entropy").alias("kind"))
        return _let(window_entropy(x["raw"], x["threshold"]), span)

    spans = F.filter(F.transform(F.transform(kept, classed), scored), lambda s: s["end"].isNotNull())
    return F.when(text.rlike(CANDIDATE), spans).otherwise(F.array().cast(_SPANS))


def scan(docs: DataFrame, text: str = "text", thresholds: dict[str, float] = THRESHOLDS, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """All of ``docs`` with ``base`` and ``found``: ``array<struct<start, rank, end, kind>>`` by start, then kind."""
    out = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    parts = [_base(kind, rank) for rank, kind in enumerate(BASE)]
    out = out.withColumns({f"__{kind}": c for kind, c in zip(BASE, parts, strict=True)})
    out = out.withColumn("__base", F.array_sort(F.concat(*(F.col(f"__{kind}") for kind in BASE))))
    out = out.withColumn("__found", F.array_sort(F.concat("__base", _entropy(len(BASE), thresholds, allowed))))
    return out


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each span of ``scan`` replaced by ``mark``; texts without spans stay as they are, nulls too."""
    columns, found = docs.columns, scan(docs, text)

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        # Spans that overlap what is cut already only move the end.
        kept = F.array(F.struct(at.alias("start"), s["start"].alias("end")))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, kept).otherwise(F.array().cast("array<struct<start:int,end:int>>"))

    # Four bytes a character: any place of the text is reached at once.
    def cut(wide: Column) -> Column:
        piece = lambda a, n: F.decode(F.substring(wide, 4 * a + 1, 4 * n), "UTF-32")
        kept = F.transform(_pass(F.col("__found"), F.lit(0), step, "array<struct<start:int,end:int>>"), lambda k: piece(k["start"], k["end"] - k["start"]))
        rest = F.array_max(F.transform("__found", lambda s: s["end"]))
        return F.array_join(F.concat(kept, F.array(piece(rest, F.length(wide)))), mark)

    clean = F.when(F.size("__found") > 0, _let(F.encode("__text", "UTF-32"), cut)).otherwise(F.col(text))
    return found.withColumn(text, clean).select(*columns)


def op6_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Counts, base digest and all spans of every whole text of ``documents``."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        *(F.size(f"__{kind}").cast("long").alias(f"n_{kind}") for kind in BASE),
        F.sha2(_joined(F.col("__base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("__found")).alias("spans"),
    )
