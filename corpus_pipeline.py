"""A corpus pipeline made of the training-data operators; its stages are run in order, each on what the one before kept.

Every stage but the last returns the columns of ``documents``. Documents without an id are
one group in the joins that carry decisions back, except where an operator defines otherwise;
near-dedup compares them like all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.llm import bpe, common, minhash, mixing, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the rejection threshold of their language."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    scored = common.materialize(toxicity.score(docs, model, into="__toxicity"), "pipeline-scored")
    toxicity.set_thresholds(model, scored, labels, "__toxicity")
    return scored.where(~toxicity.rejected(model, F.col("lang"), "__toxicity")).select(*docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__id``: the id, or for texts without one a number of the text's digest beyond all ids.

    So documents with ids stay before those without, and copies without ids share a number.
    """
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    digest = F.conv(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 15), 16, 10).cast("bigint")  # 60 bits
    low, high = low or 0, high or 0
    if high < 1 << 62:
        other = F.lit(max(high, 0) + 1) + digest
    elif low > -(1 << 62):
        other = F.lit(min(low, 0) - 1) - digest
    else:
        raise ValueError("ids leave no room for numbers of documents without one")
    return docs.withColumn("__id", F.coalesce("doc_id", other))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the lowest id, once; those without an id come last."""
    no_words = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(common.WORD_REGEX), F.lit(False))
    keyed = _keyed(docs.where(~no_words))
    own = keyed.select(F.col("__id").alias("doc_id"), "text")
    gone = minhash.classes(own).where("doc_id <> class_id").select(F.col("doc_id").alias("__id")).distinct()
    gone = common.materialize(gone, "pipeline-gone")
    some, others = common.sifted(keyed, "__id", gone)  # those that go are fewer than those that stay
    stays = others.unionByName(some.join(gone, "__id", "left_anti"))
    if minhash._repeats(own):
        place = F.row_number().over(Window.partitionBy("__id").orderBy(F.xxhash64("text"), "source", "lang"))
        stays = stays.withColumn("__place", place).where("__place = 1")
    return stays.select(*docs.columns).unionByName(docs.where(no_words))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; ``n_chars`` follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes their words: whole times, and once more with the chance of the rest."""
    return mixing.resample(docs).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the digest of their decoded text."""
    return bpe.encode_decode(docs, keep=("doc_id", "lang", "source"), with_text=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("bpe", tokenize),
]

#: Trained models and hash-drawn mixes are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = common.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialize(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
