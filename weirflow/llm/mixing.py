"""Mixing sources to target weights with DataFrame functions only.

A source's documents, in a fixed order, are one stream of words cut into blocks of ``BLOCK``
words. Targets come from the sources' weights. Each output shard of ``SHARD`` slots draws how
many of its slots each source gets (a multinomial draw: every slot picks a source by a hash of
its number against the cumulative shares); what a source draws beyond its quota is redrawn
among those below theirs, so that totals meet the targets. A source's slots, numbered through
all shards, are mapped to its blocks by one pseudorandom permutation an epoch, and blocks are
joined by index. Words of a document are taken as often as the blocks that hold them.

Scale: texts never leave the scan, only their word counts do. Places in a source's stream are
prefix sums in two levels (pieces of a source, then documents of a piece), so that a hot source
is many tasks' work. The tables of sources and of (source, piece) are small aggregates.

Defined cases: a null text has size 0; documents of size 0 are never taken; a null source is a
source of its own, after all others. Documents with equal id, text size and text hash share
places in any order with the same totals. Reruns agree: only hashes of ids and numbers decide.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm import common

#: Words of a block, and slots of an output shard.
BLOCK, SHARD = 128, 1024
#: Most times that a source's words may be taken.
MOST = 3
SEED = 20
#: Documents of one piece of all sources, on average; numbered rows that one window sorts.
PIECE, RUN = 512, 4096
#: Equal parts of the unit interval by which slots find their source.
PARTS = 4096
#: Rounds of the permutation, and steps back into its domain (enough for any number of blocks, see ``permuted``).
ROUNDS, WALKS = 6, 16


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``: one more than the gaps inside the trimmed text."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(common.WORD_REGEX), F.lit(0))), F.lit(0)).cast("long")


def before(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the same keys with a smaller ``order``, a unique number.

    In two levels, so that no task sorts more than ``RUN`` rows of a key, or one row for each such run.
    """
    run = F.floor(F.col(order) / RUN).alias("__run")
    runs = df.groupBy(*keys, run).agg(F.sum(value).alias("__sum"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    runs = runs.withColumn("__since", F.sum("__sum").over(whole.orderBy("__run")) - F.col("__sum")).drop("__sum")
    inside = Window.partitionBy(*keys, "__run").orderBy(order)
    out = df.withColumn("__run", run).withColumn("__within", F.sum(value).over(inside) - F.col(value))
    return out.join(runs, [*keys, "__run"]).withColumn(name, F.col("__since") + F.col("__within")).drop("__run", "__since", "__within")


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, size and a tie-breaking hash; written down, as three readers follow."""
    out = docs.select("doc_id", "source", word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("tie"))
    return common.materialize(out, "mix-sizes")


def targets(sized: DataFrame, weights: Column | None = None, most: int = MOST) -> DataFrame:
    """One row a source: ``place`` by code point (null last), ``weight``, ``source_size``, ``target``.

    Targets are shares of all words by weight, stopped at ``most`` times the source's words, the
    excess reshared. The fixed point has a closed form: sources in the order of (cap / weight)
    are capped as long as the share of those before them leaves them above their cap.
    """
    one = F.lit(1)
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    out = by_source.withColumn("place", place).withColumn("weight", (F.col("place") % 3 + one if weights is None else weights).cast("double"))
    out = out.withColumn("cap", (most * F.col("source_size")).cast("double"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "place")
    everything = Window.partitionBy(F.lit(0))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns(
        {
            "__left": F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)),
            "__weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)),
        }
    )
    # The level at which the first uncapped source stands holds for all after it.
    share = F.col("__left") / F.col("__weight")
    out = out.withColumn("__level", F.when(share * F.col("weight") <= F.col("cap"), share))
    level = F.first("__level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("target", F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))).select("source", "place", "weight", "source_size", "target")


def quotas(goal: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds ``blocks`` of each source and ``quota``, the slots whose blocks hold about the target's words."""
    size = F.col("source_size")
    blocks = F.ceil(size / block).cast("long")
    quota = F.when(size > 0, F.least(MOST * blocks, F.round(F.col("target") * blocks / size).cast("long"))).otherwise(F.lit(0))
    return goal.withColumn("blocks", blocks).withColumn("quota", quota.cast("long"))


def permuted(index: Column, size: Column, *key: Column) -> Column:
    """A pseudorandom permutation of ``0 .. size - 1`` for each key.

    A Feistel network on pairs (a row and a column of the smallest near-square table that holds
    ``size`` places), walked on while the place lies beyond ``size``. Fewer than ``rows`` places do,
    less than one in ``rows``, so WALKS steps leave with certainty up to 16 rows and else but for
    a chance of 17 ** -16.
    """
    rows = F.ceil(F.sqrt(size.cast("double"))).cast("long")
    columns = F.ceil(size / rows).cast("long")

    def once(x: Column) -> Column:
        # left < a and right < b change places each round; the left part is shifted by a hash of the right one.
        def round_(acc: Column, r: Column) -> Column:
            a = F.when(r % 2 == 0, rows).otherwise(columns)
            moved = F.pmod(acc["left"] + F.pmod(F.xxhash64(acc["right"], r, *key), a), a)
            return F.struct(acc["right"].alias("left"), moved.alias("right"))

        start = F.struct(F.floor(x / columns).cast("long").alias("left"), (x % columns).alias("right"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, round_, lambda acc: acc["left"] * columns + acc["right"])

    walk = lambda x, _: F.when(x < size, x).otherwise(once(x))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once(index), walk)


def draw(goal: DataFrame, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """The plan of the mix: ``shard``, ``place`` (of the source), ``slot`` of that source, ``block``.

    ``goal`` is the table of ``quotas``.
    """
    spark = goal.sparkSession
    total = goal.agg(F.sum("quota")).first()[0] or 0
    ends = F.sum("quota").over(Window.partitionBy(F.lit(0)).orderBy("place"))
    shares = goal.where("quota > 0").select("place", "quota", (ends / F.lit(max(1, total))).alias("upper"))
    shares = shares.withColumn("lower", F.coalesce(F.lag("upper").over(Window.partitionBy(F.lit(0)).orderBy("place")), F.lit(0.0)))
    last = F.max("place").over(Window.partitionBy(F.lit(0)))
    shares = shares.withColumn("upper", F.when(F.col("place") == last, F.lit(2.0)).otherwise(F.col("upper")))
    parts = shares.withColumn("part", F.explode(F.sequence(F.floor(F.col("lower") * PARTS).cast("long"), F.least(F.floor(F.col("upper") * PARTS), F.lit(PARTS - 1)).cast("long"))))

    slots = spark.range(total).select(F.floor(F.col("id") / shard).alias("shard"), (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 52)) / float(1 << 52)).alias("u"))
    drawn = slots.withColumn("part", F.floor(F.col("u") * PARTS)).join(parts, "part").where("u >= lower and u < upper")
    counts = drawn.groupBy("shard", "place").agg(F.count("*").alias("n"))
    counts = common.materialize(counts, "mix-draws")

    # Slots of a source are numbered through the shards; those past its quota are given to sources below theirs.
    numbered = before(counts, ["place"], "shard", "n", "from").join(goal.select("place", "quota"), "place")
    held = common.materialize(numbered.withColumn("to", F.least(F.col("from") + F.col("n"), F.col("quota"))), "mix-numbered")
    kept = held.where("to > from").select("shard", "place", "from", "to")
    over = held.withColumn("free", F.col("n") - F.greatest(F.lit(0), F.col("to") - F.col("from"))).where("free > 0").groupBy("shard").agg(F.sum("free").alias("free"))
    over = before(over, [], "shard", "free", "since").withColumn("upto", F.col("since") + F.col("free"))
    drawn_of = counts.groupBy("place").agg(F.sum("n").alias("drawn"))
    under = goal.select("place", "quota").where("quota > 0").join(drawn_of, "place", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).where("drawn < quota")
    under = under.withColumn("upto_", F.sum(F.col("quota") - F.col("drawn")).over(Window.partitionBy(F.lit(0)).orderBy("place"))).withColumn("since_", F.col("upto_") - (F.col("quota") - F.col("drawn")))
    # Free slots and missing ones are two divisions of the same line; cut into stretches they meet by equality.
    wide = 1024
    cut = lambda t, a, b: t.withColumn("stretch", F.explode(F.sequence(F.floor(F.col(a) / wide), F.floor((F.col(b) - 1) / wide))))
    given = cut(over, "since", "upto").join(cut(under, "since_", "upto_"), "stretch")
    first = F.greatest("since", "since_", F.col("stretch") * wide)
    end = F.least("upto", "upto_", (F.col("stretch") + 1) * wide)
    given = given.withColumn("a", first).withColumn("b", end).where("b > a")
    given = given.select("shard", "place", (F.col("drawn") + F.col("a") - F.col("since_")).alias("from"), (F.col("drawn") + F.col("b") - F.col("since_")).alias("to"))

    plan = kept.unionByName(given).join(goal.select("place", "blocks"), "place")
    plan = plan.repartition(common.partitions_for(plan), "shard", "place")  # before rows multiply
    plan = plan.withColumn("slot", F.explode(F.sequence(F.col("from"), F.col("to") - 1)))
    epoch = F.floor(F.col("slot") / F.col("blocks"))
    return plan.select("shard", "place", "slot", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("place"), epoch).alias("block"))


def streams(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """``sized`` with ``place`` and ``start``: where each document of some size begins in its source's stream."""
    some = sized.where("size > 0").alias("d").join(goal.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select("d.*", "place", "source_size", "target")
    n = sized.where("size > 0").count()
    some = some.withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-n // PIECE)))))
    pieces = before(some.groupBy("place", "piece").agg(F.sum("size").alias("words")), ["place"], "piece", "words", "before").select("place", "piece", "before")
    inside = Window.partitionBy("place", "piece").orderBy("doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = some.withColumn("within", F.sum("size").over(inside) - F.col("size"))
    start = (F.col("before") + F.col("within")).alias("start")
    return some.join(pieces, ["place", "piece"]).select("doc_id", "source", "size", "place", "source_size", "target", start)


def mix(docs: DataFrame, text: str = "text", block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken."""
    sized = sizes(docs, text)
    goal = common.materialize(quotas(targets(sized), block), "mix-goal")
    plan = draw(goal, shard, seed)
    # Written down, as each of the driver's plans stays small then; one row for each block that is taken.
    times = common.materialize(plan.groupBy("place", "block").agg(F.count("*").alias("times")), "mix-times")
    common.rest(docs.sparkSession)
    placed = streams(sized, goal)
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), last)))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)
    pieces = pieces.withColumn("words", words).join(times, ["place", "block"], "left")
    found = pieces.groupBy("doc_id", "source", "size", "source_size", "target", "start").agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).cast("long").alias("taken")).drop("start")
    none = sized.where("size = 0").alias("z").join(goal.alias("g"), F.col("z.source").eqNullSafe(F.col("g.source")))
    none = none.select("doc_id", "z.source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return found.unionByName(none)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def resample(docs: DataFrame, text: str = "text", seed: int = SEED) -> DataFrame:
    """Rows of ``docs`` repeated as the mix takes their words, whole documents at a time.

    A document whose words are taken ``taken / size`` times stands so many whole times, and once
    more if a hash of its id falls below the rest; the expected number of words is ``taken``.
    Documents without words, which no target counts, stay once.
    """
    names = docs.columns
    taken = mix(docs, text, seed=seed).groupBy("doc_id").agg(F.sum("taken").alias("__taken"), F.sum("size").alias("__size"))
    joined = docs.join(taken.withColumnRenamed("doc_id", "__id"), docs["doc_id"].eqNullSafe(F.col("__id")))
    times = F.col("__taken") / F.col("__size")
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) / float(1 << 52)
    copies = F.when(F.col("__size") == 0, F.lit(1)).otherwise((F.floor(times) + (chance < times - F.floor(times)).cast("int")).cast("int"))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1))))).where(copies > 0).select(*names)
