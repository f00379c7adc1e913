"""The corpus pipeline: toxicity filter, near-duplicate removal, decontamination, sanitisation, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

In all stages null texts count as empty, an empty table gives an empty one, further columns are kept as they are, very
long texts are read whole, and rows that repeat are judged alike. Rows without doc_id have no label, no copy and no
passage, so they stay until they are packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate as clean
from tidewatch.llm.near_dup import near_duplicates
from tidewatch.llm.packing import packing_digest
from tidewatch.llm.pii import sanitise
from tidewatch.llm.toxicity import THRESHOLD, fit_toxicity, held_out, score_toxicity
from tidewatch.sources.scratch import cut



def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at the threshold or over it go; empty ones have the lowest score."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model, score = fit_toxicity(docs, labels.where(~held_out())), "_toxicity"
    while score in docs.columns:
        score = f"_{score}"
    return score_toxicity(docs, model, score).where(F.col(score) < THRESHOLD).drop(score)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the smallest id. Empty texts are copies of nothing,
    repeated rows of one id stay together, and so do rows without an id."""
    gone = near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage like a benchmark item go; without items, none."""
    return clean.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that reveal it are replaced or removed; n_chars follows the text."""
    out = sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing_digest(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicate", near_duplicate),
    ("decontamination", decontamination),
    ("sanitisation", sanitisation),
    ("packing", packing),
]

#: SQL can't express the string kernel, the tokenizer or the components; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
