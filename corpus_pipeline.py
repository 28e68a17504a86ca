"""The corpus pipeline: documents through five stages, each one operator.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the
next one's docs.  All but the last return the columns of their docs.

Language ID drops documents in no known language.  SimHash keeps one document
of each near-duplicate group.  Decontamination drops documents that hold a
benchmark item.  The secret scan keeps every document and writes secrets as
[SECRET].  Mixing gives every document left its number of copies and words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmament.llm import decontaminate, langid, mixing, secret_scan, simhash
from firmament.llm.queries import VOCABULARY
from firmament.llm.store import saved, ship, text_key, unused


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return langid.accepted(docs, langid.train(langid.learned(docs)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group; rows that repeat id and text are one document."""
    ship(spark)
    # one key for id and text: the join and the dropping of repeats share one shuffle
    row = unused(docs, "row")

    def row_key(text: Column) -> Column:
        return F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text).cast("binary")).alias(row)

    groups = simhash.near_duplicates(docs).filter("kept")
    kept = saved(groups.select(row_key(F.col("text_key"))).distinct(), "kept")
    keyed = docs.select("*", row_key(text_key(F.col("text"))))
    return keyed.join(kept, row, "left_semi").dropDuplicates([row]).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return secret_scan.redact(docs, secret_scan.dictionary(VOCABULARY))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [("language ID", language), ("SimHash near-dedup", near_copies), ("benchmark decontamination", benchmark), ("secret scans", secrets), ("mixing sources to target weights", mixture)]

#: The learned language model has no SQL form; tests compare the rest with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of the documents table: one row per document that the stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
