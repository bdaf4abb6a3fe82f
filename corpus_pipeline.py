"""The corpus pipeline: toxic documents go, then those without a recognisable language, then near-duplicates, then
repeated passages; what is left is packed into sequences.

Each stage works on all that the one before kept and is written as Parquet before the next begins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlab.llm import common as C
from rosterlab.llm import op4_toxicity, op5_language, op7_substrings, op9_partenum, op10_packing
from rosterlab.session import shared_folder

#: A language below this calibrated probability is none; texts without letters have probability 0.
LEAST_LANGUAGE_SCORE = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half, learned from the labels of documents that are still there."""
    scorer = op4_toxicity.fit(docs, C.table(spark, sf_dir, "labels"))
    return op4_toxicity.score(docs, scorer, out="_score").where("_score < 0.5").drop("_score")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language, learned from the documents' own language column where it is set."""
    train = docs.withColumn("lang", F.when(~F.coalesce(op5_language.held_out(), F.lit(False)), F.col("lang")))
    scored = op5_language.predict(docs, op5_language.fit(train), out="_lang", score="_score")
    return scored.where((F.col("_lang") != op5_language.UNKNOWN) & (F.col("_score") >= LEAST_LANGUAGE_SCORE)).drop("_lang", "_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents, one with the smallest doc_id; repeated rows go too."""
    return op9_partenum.kept_documents(spark, docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that begin earlier elsewhere; n_chars follows the text."""
    return op7_substrings.kept_documents(spark, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their places in sequences."""
    return op10_packing.packed_documents(spark, docs)


STAGES = [
    ("toxicity", toxicity),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: No SQL expresses the trained stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table `documents` of sf_dir."""
    docs = C.table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        found = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return found
        path = f"{folder}/{i}-{name}"
        found.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
