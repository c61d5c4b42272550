"""A training-data pipeline over ``documents``: each stage takes all that the one before kept and returns the columns of documents.

The last stage returns token ids.  Between stages the rows are Parquet tables
under ``spark.checkpoint.dir``, so a lost executor costs one stage's tasks.

Every stage judges rows, not ids: rows of one id, or without one, stay or go each
by its own text, and equal rows by the rules below.  Columns other than those of
``COLUMNS`` are not read and may have any name; an empty table goes through all
stages as one.  Very long texts are read whole by every stage.

* toxicity: a null or empty text has no evidence and stays
* line dedup: null texts stay null; equal rows of one id are one document
* near-dedup: rows without words are one group; one row of a group stays, that of
  the smallest id, null ids last
* decontamination: a row without words stays; an empty benchmark rejects nothing
* encoding: a null or empty text has no ids
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, lines, near, pieces, toxicity
from tidemark.llm.queries import held_out, model_path
from tidemark.sources.shared import shared_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


TOXIC_FROM = 0.7
LONG_LINE = 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC_FROM, with a model from the labels that may be learnt from."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(F.col("id")), whole=True)
    return toxicity.score_rows(docs, model).filter(F.col("score") < TOXIC_FROM).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of later copies of line runs, and of single lines of LONG_LINE words."""
    return lines.remove_repeated_lines(docs, long_words=LONG_LINE).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 0.8 similarity or more in five-word shingles, that with the smallest id: SimHash first, then shingle sets for what it can't find."""
    return near.keep_first(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of the benchmark occurs."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document: ``(doc_id, n_tokens, ids)``."""
    return pieces.encode_decode(docs, model_path()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-dedup by shingle sets", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", tokenize),
]
#: Model scores and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
