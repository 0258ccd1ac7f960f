"""Binary assets: bytes with their fingerprint, checked against recorded sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def scan(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, filename, content, size_bytes and sha256 of every file."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        "content",
        F.length("content").cast("long").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


def check_sizes(scanned: DataFrame, declared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files whose size equals the declared one, and rejects.

    declared: path, declared_size (NULL when unknown). The comparison runs
    without the content, so only keys and sizes are shuffled for rejects.
    """
    joined = scanned.join(declared, "path", "left")
    differs = F.coalesce(F.col("declared_size") != F.col("size_bytes"), F.lit(False))
    rejects = joined.filter(differs).select("path", "declared_size", "size_bytes", F.lit("size_mismatch").alias("error"))
    return joined.filter(~differs).drop("declared_size"), rejects
