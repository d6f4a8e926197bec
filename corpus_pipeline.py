"""Five-stage cleaning of ``documents``: each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railweave.llm import jaccard, lines, mixing, packing, toxicity
from railweave.llm.store import keep

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay."""
    return toxicity.drop_toxic(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def site_lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a tenth of a source's distinct texts go; documents stay.

    Copies count once: they are the next stage's work, which keeps one of each. A
    tenth is operator 10's ratio, and the common line of check_h stands on 26 to
    30 % of a source's distinct texts, so 0.3 would leave it in all sources but one.
    """
    cut = lines.drop_site_lines(docs.select(*COLUMNS), "doc_id", "text", "source", ratio=0.1, by_text=True)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard.keep_first_of_each(docs).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in token sequences."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxic_out), ("line dedup", site_lines_out), ("n-gram jaccard", near_copies_out), ("source mixing", mixed), ("packing", packed)]
#: Tokens, trees and components are beyond SQL; tests/llm holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
