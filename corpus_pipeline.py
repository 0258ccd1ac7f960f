"""A training-corpus pipeline: language, quality, near-duplicates, benchmark leaks, packing.

Every stage takes the documents that the one before kept and returns documents
with the same columns; the last returns where their tokens are packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from worklens.llm import decontamination, jaccard_join, language_crf, packing, quality
from worklens.llm.common import unused
from worklens.session import written

#: A document stays where its language holds at least this share of its words. Of clean documents no held-out one
#: scored below 0.47, an even mixture of two languages scores about 0.5, of three about 0.36, of four about 0.28.
LANGUAGE_SHARE = 0.45
#: A document stays where its quality score is at least this.
QUALITY_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language; those without letters, and mixtures without a main language, go.

    Null and empty texts have no letter and go; texts of any length count whole. Repeated rows, null ids
    and ties of languages are decided by the text alone, so equal texts stay or go together. Without any
    labelled language nothing is known and every document goes; an empty table stays empty. Other columns
    pass through, whatever their names.
    """
    language, share = unused(docs.columns, "language", "share")
    model = language_crf.fit(docs, F.lit(True))
    scored = language_crf.with_language(docs, model, label=language, share=share)
    kept = (F.col(language) != language_crf.UNKNOWN) & (F.col(share) >= LANGUAGE_SHARE)
    return scored.filter(kept).select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labelled ones does not score as low quality.

    Null and empty texts get the base score of the model; texts of any length count whole. Equal texts,
    repeated rows and null ids score alike. Without labels every score is 0.5 and all stay; an empty table
    stays empty. Other columns pass through, whatever their names.
    """
    (score,) = unused(docs.columns, "score")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    scored = quality.with_quality(docs, model, into=score)
    return scored.filter(F.col(score) >= QUALITY_SCORE).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by word n-grams: that with the smallest id.

    Rows with null or blank texts link with nothing and all stay; of texts of any length the whole set
    counts. Of equal ids the text with the smallest digest stays, of repeated rows one; a null id comes after all
    others. An empty table stays empty. Other columns pass through, whatever their names.
    """
    return jaccard_join.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item, not even with some edits.

    Null and empty texts hold none and stay; texts of any length are searched whole. Repeated rows and
    null ids are decided one by one, by the text. Without test items all stay; an empty table stays empty.
    Other columns pass through, whatever their names.
    """
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bin, offset and capacity of every piece of every document.

    A null or empty text is one end mark; a text longer than the largest bin is cut into pieces that all
    keep their place. Repeated rows and null ids are packed each; equal lengths are taken by id. An empty
    table has no bins. Other columns take no part.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("sequence_packing", sequence_packing),
]

#: The classifiers and the packing have no SQL; tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
