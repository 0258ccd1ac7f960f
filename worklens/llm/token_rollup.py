"""Token counts: additive totals kept up to date by signed, idempotent batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from worklens.llm.common import WORD

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


def words_v1(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def words_v2(text: Column) -> Column:
    """Runs of letters and digits, and every other visible character for itself."""
    pattern = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("long")


def bpe_counts(docs: DataFrame, ranks_path: str, text: str = "text", into: str = "tokens") -> DataFrame:
    """The rows with the number of byte-level BPE tokens of the text; null texts have none.

    ``ranks_path`` names a vocabulary file (base64 token and rank per line) that every
    worker can read; texts that look like special tokens are ordinary text.
    """
    kept = docs.drop(into)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, into])

    return kept.mapInArrow(count, T.StructType([*kept.schema.fields, T.StructField(into, T.LongType())]))


def changes(rows: DataFrame, tokenizer: str, tokens: Column, sign: int, source: str = "source", lang: str = "lang") -> DataFrame:
    """One signed row per document: +1 inserts its count, -1 takes it back."""
    return rows.select(
        F.col(source).cast("string").alias("source"),
        F.col(lang).cast("string").alias("lang"),
        F.lit(tokenizer).alias("tokenizer"),
        F.lit(sign).cast("long").alias("docs"),
        (F.coalesce(tokens.cast("long"), F.lit(0).cast("long")) * sign).alias("tokens"),
    )


def inserted(rows: DataFrame, tokenizer: str, tokens: Column) -> DataFrame:
    return changes(rows, tokenizer, tokens, 1)


def deleted(rows: DataFrame, tokenizer: str, tokens: Column) -> DataFrame:
    return changes(rows, tokenizer, tokens, -1)


def revised(rows: DataFrame, old: tuple[str, Column], new: tuple[str, Column]) -> DataFrame:
    """Takes the old count back and adds the new one, which may belong to another tokenizer version."""
    return deleted(rows, *old).unionByName(inserted(rows, *new))


def commit(batch_id: str, signed: DataFrame, path: str) -> None:
    """Adds a batch to the rollup at ``path``.

    The signed rows are summed per source, language and tokenizer version before
    they are shuffled, so a hot source costs one row per task. A batch owns the
    folder of its id and replaces it as a whole: committing it again, after a lost
    executor or a repeated delivery, leaves the totals as they are. The order of
    batches does not matter. An empty batch is a batch without rows.
    """
    if not batch_id or any(c in batch_id for c in "/=\\"):
        raise ValueError(f"batch id {batch_id!r} cannot name a folder")
    summed = signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    summed.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def totals(spark: SparkSession, path: str) -> DataFrame:
    """Totals of all committed batches: (source, lang, tokenizer, docs, tokens).

    Null sources and languages are groups of their own. A group whose documents are
    all taken back again has no row. Negative totals stay visible: they mean that a
    batch which takes back arrived before, or without, the one that adds.
    """
    batches = spark.read.schema(SCHEMA).parquet(f"{path}/batch=*")
    summed = batches.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return summed.filter((F.col("docs") != 0) | (F.col("tokens") != 0))
