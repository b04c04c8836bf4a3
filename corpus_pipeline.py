"""Training-text pipeline: quality, near duplicates, benchmark leaks, secrets, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelift.llm import decontaminate, nearjoin, quality, secrets, tokenize
from panelift.llm.catalog import table
from panelift.session import scratch_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more; the model learns from the labelled rows of ``documents``."""
    model = quality.fit_on_labels(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score(docs, model, output="_score").where("_score >= 0.5").drop("_score")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays."""
    return nearjoin.keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"), output="_hits")
    return found.where(F.size("_hits") == 0).drop("_hits")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced; n_chars is counted anew where a text changed."""
    masked = secrets.mask(docs, secrets.find(docs))
    return masked.withColumn("n_chars", F.when(F.col("text").contains(secrets.MASK), F.length("text")).otherwise(F.col("n_chars")).cast("long"))


def add_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the piece ids of their text and their number."""
    return tokenize.encode(docs, ids="ids").withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", mask_secrets),
    ("SentencePiece encoding", add_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.split(" ")[0].lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The trained stages and the tokens are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None
