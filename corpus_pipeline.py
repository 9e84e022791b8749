"""From raw documents to packed training sequences, stage by stage.

Each stage is a function (spark, docs, sf_dir) -> DataFrame whose result is written
as Parquet and read again as the next stage's docs; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import mixing, packing, quality, simhash, suffix_array
from rivulet.session import save


#: Bytes of a repeated passage that go, at the least: passages of over 50 words have more in any of the languages.
PASSAGE = 200


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.kept(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of passages that occur elsewhere; a text may become empty."""
    done = suffix_array.remove_repeated_bytes(docs, PASSAGE)
    new = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return (done.withColumn("n_chars", new) if new is not None else done).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it is taken."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents in sequences of fixed size."""
    return packing.best_fit(docs)


STAGES = [
    ("quality classifier", classify),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("mixing", mix),
    ("best-fit packing", pack),
]

#: SQL can't express fitting a classifier or tokenising; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = save(docs, "stage")
    return docs
