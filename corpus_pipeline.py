"""From raw documents to shuffled shards: each stage is one operator over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import decontamination, mixing, quality, sharding, simhash
from panelwright.llm.store import frozen, release, row_hash, scratch, without

SHARDS = 40


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a grade above the lowest reaches one half.

    A null or empty text is judged by the feature that stands for no words. Repeated rows are judged alike;
    rows without an id are judged too, and never learned from. Without labels every row stays. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accept(docs, quality.fit(docs, quality.grades_of(labels)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest doc_id.

    Null ids come last, and of rows of one id one stays. Null and empty texts have one fingerprint, so
    one of them stays. An empty table stays empty.
    """
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten consecutive words of a benchmark item.

    Null and empty texts have no words and stay; repeated rows are judged alike. An item of fewer than ten
    words counts as a whole, one without id or words not at all. Without items every row stays. An empty table stays empty.
    """
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times (0 to 2) as the mix takes it; copies are equal rows.

    Null sources are a source of their own; a text without words gets the certain copies alone. Equal
    rows are drawn one by one. An empty table stays empty.
    """
    held = frozen(without(docs, "__row", "__same").withColumns({"__row": F.monotonically_increasing_id(), "__same": row_hash(docs)}), "to-mix")
    rows = held.select("__row", "__same", "source", mixing.word_count(F.col("text")).alias("size"))
    taken = frozen(mixing.mix(rows, identity=F.col("__same")).where("copies > 0").select("__row", "copies"), "taken")
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__time")
    return held.join(taken.hint("merge"), "__row").select(*docs.columns, times).drop("__time")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with row_number, shard and slot, shards at most one row apart.

    Nulls are ordinary values; equal rows take places of their own. An empty table stays empty.
    """
    return sharding.shard(docs, SHARDS)


STAGES = [("quality classifier", classify), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("source mixing", mix), ("sharding", shard)]

ORACLE_SQL = None  # the stages learn weights and draw at random, which SQL can't express


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and reread as the next one's input.

    What a stage writes on its way goes when its result is written, and that goes when the next one is.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch() as kept:
            docs = frozen(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            kept.append(docs)
        release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
