"""The corpus pipeline: language ID, exact dedup, near-dedup, benchmark
decontamination, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each result as Parquet in the shared folder and reads it as the next
stage's documents.

What holds for all stages: rows are told apart by id and text, so null ids and
ids that repeat with another text stand for themselves; a null text counts as
empty; an empty table gives an empty result; columns of any other name go
through as they are, whatever names the operators use inside.  The first four
return all columns of their documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, exact, langid, mixing, neardup
from tessera.llm.common import settled, with_text_key


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model doesn't reject: those with a letter
    that aren't far from every centroid.  The columns stay as they are; a
    missing lang isn't filled in.  Null and empty texts and texts without a
    letter go; repeated rows share a decision; without a labelled row nothing goes."""
    model = langid.fit(docs.filter(~langid.is_held_out()))
    if not model.labels:  # nothing to learn from: nothing is known to be foreign
        return docs
    flag = _free_name(docs)
    return docs.withColumn(flag, langid.identify(docs, model)).filter(~F.col(f"{flag}.rejected")).drop(flag)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the most code points,
    then the smallest id (null first); one of rows that repeat it throughout."""
    return exact.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest id; rows
    with a null id, and texts without words, are no one's copies.  A text under
    five words is one shingle."""
    return neardup.drop_near_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.  Null and empty texts hold none;
    of rows with one id only those whose own text leaks go; null and empty items
    are in no document, and an empty benchmark takes nothing out."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, h = with_text_key(docs, "text")
    # The row's id and text decide, as ids may be null or repeat.
    named = rows.select(F.struct(F.col("doc_id").alias("i"), F.col(h).alias("h")).alias("row"), "text")
    leaks = decontam.find_leaks(named, items, id_col="row").select(F.col("id.i").alias("_leaks"), F.col("id.h").alias("_leaks_h")).distinct()
    return rows.join(leaks, rows["doc_id"].eqNullSafe(leaks["_leaks"]) & (rows[h] == leaks["_leaks_h"]), "left_anti").drop(h)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, a row per document (repeated
    rows one by one).  A null source is a source; texts without words take 0."""
    return mixing.mix_sources(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("mixture", mixture),
]

# Near-duplicate classes, BM25 search and dependent rounding aren't SQL: tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def _free_name(docs: DataFrame) -> str:
    name = "_found"
    while name in docs.columns:
        name += "_"
    return name
