"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes all that the one before kept, and all but the last return the columns of documents. Written between
stages by whoever runs them; run() chains them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm import minhash, mixing, packing, quality, substring_dedup
from loomtrace.llm.common import table, written
from loomtrace.llm.queries import MIX_WEIGHTS


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labels, does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter("quality_label = 1").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.keep_one(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat."""
    cut = substring_dedup.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources reach their target weights, in random order."""
    return mixing.mix(docs, MIX_WEIGHTS).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("minhash near-dedup", keep_one_of_each),
    ("substring dedup", remove_repeats),
    ("source mixing", mix_sources),
    ("packing", pack),
]

#: Classifier, samples and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES, start=1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = written(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
