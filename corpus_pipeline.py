"""Corpus pipeline: quality, language, repeated lines, near duplicates, packing.

Each stage reads what the one before it kept. All but the last return the columns of ``documents``;
the last returns one row for each piece of a packed sequence. SQL cannot express the models and the
templates, so ORACLE_SQL is None and tests compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import language_id, line_dedup, ngram_join, packing, quality
from cohortloom.llm.common import discard, kept, sweep
from cohortloom.llm.queries import ACCEPTED

SURE = 0.5
"""Least posterior of a language that a document may have."""


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least ``ACCEPTED``; a null or blank text has the prior's score."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    clash = "score" in docs.columns
    renamed = docs.withColumnRenamed("score", "__score") if clash else docs
    good = quality.scored(renamed, model).filter(F.col("score") >= ACCEPTED).drop("score")
    return good.withColumnRenamed("__score", "score").select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and one language that the model is sure of; lang is not changed."""
    pieces = language_id.load_pieces()
    model = language_id.train(docs, pieces, F.lit(True))
    names = {c: f"__{c}" for c in ("score", "lang_pred") if c in docs.columns}
    found = language_id.identify(docs.withColumnsRenamed(names), model, pieces)
    sure = found.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= SURE)).drop("score", "lang_pred")
    return sure.withColumnsRenamed({v: k for k, v in names.items()}).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines; a document of which nothing is left goes. n_chars follows the text."""
    names = {c: f"__{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}
    cut = line_dedup.dedup_lines(docs.withColumnsRenamed(names))
    cut = cut.filter((F.col("n_dropped") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, size).otherwise(F.col("n_chars")))
    return cut.drop("n_lines", "n_dropped").withColumnsRenamed({v: k for k, v in names.items()}).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked ones; rows without an id stay."""
    sweep(spark)  # line dedup leaves large shuffles
    first = ngram_join.jaccard_components(docs).filter("doc_id = component_id").select(F.col("doc_id").alias("__doc")).distinct()
    return docs.join(first, docs.doc_id.cast("long") == F.col("__doc"), "left_semi").union(docs.filter("doc_id is null"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, special=True)


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_near_copies),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again; only the last table stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if name != STAGES[0][0]:
            discard(before, shuffles=True)
    return STAGES[-1][1](spark, docs, sf_dir)
