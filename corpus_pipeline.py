"""The corpus pipeline: toxicity, line deduplication, near-duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents (with n_chars of the text as it then is).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veritally.llm import contamination, lines, minhash, packing, toxicity
from veritally.llm.common import read, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity of 0.3 or more, by a model of the labels outside the held-out fold."""
    return toxicity.clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs, and documents of which nothing is left."""
    done = lines.dedup_lines(docs)
    left = done.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that with the smallest id.

    The join is a merge join at every size: few ids would be broadcast, many shuffle all texts, and the cost would jump.
    """
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(stored(gone, "gone", small=True).hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item or a paraphrase of one."""
    return contamination.clean(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 1024."""
    return packing.pack(stored(packing.tokenise(docs, packing.vocabulary()), "pieces"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("minhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: None of the stages but the second can be said in SQL; tests/llm compares the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
