"""Pluggable model calls, batched per partition: vectors, texts, fields, plans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from worklens import vocab
from worklens.functions.vectors import l2_normalize

Embed = Callable[[list[str]], list[list[float]]]


def embed_with(
    df: DataFrame,
    make_client: Callable[[], Embed],
    text: str = "chunk_text",
    out: str = "embedding",
    batch_size: int = 64,
    max_concurrency: int | None = None,
) -> DataFrame:
    """Adds unit vectors from an external model.

    One client per task; the number of partitions bounds the concurrent calls.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make_client()
        for texts in batches:
            values = texts.tolist()
            vectors: list[list[float]] = []
            for start in range(0, len(values), batch_size):
                vectors.extend(client(values[start : start + batch_size]))
            yield pd.Series([_unit(v) for v in vectors], index=texts.index, dtype="object")

    source = df if max_concurrency is None else df.repartition(max_concurrency)
    return source.withColumn(out, call(F.col(text)))


def _unit(vector: list[float]) -> np.ndarray:
    v = np.asarray(vector, dtype="float64")
    length = np.linalg.norm(v)
    return (v / length if length else v).astype("float32")


def embed_offline(df: DataFrame, text: str = "chunk_text", out: str = "embedding", size: int = vocab.VECTOR_SIZE) -> DataFrame:
    """Deterministic bag-of-words vectors without a model; stays in the JVM."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+"), lambda w: w != "")
    hashed = HashingTF(numFeatures=size, inputCol="_words", outputCol="_tf").transform(df.withColumn("_words", words))
    return hashed.withColumn(out, l2_normalize(vector_to_array("_tf")).cast("array<float>")).drop("_words", "_tf")


def extract_texts(files: DataFrame, make_extractor: Callable[[], Callable[[bytes, str], str]]) -> DataFrame:
    """Text of every file by an external extractor; a failed row keeps its error instead.

    files: path, filename, content.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = make_extractor()
        for batch in batches:
            results = [_attempt(extract, bytes(c), n) for c, n in zip(batch["content"], batch["filename"])]
            yield pd.DataFrame(
                {
                    "path": batch["path"],
                    "filename": batch["filename"],
                    "text": [r[0] for r in results],
                    "error": [r[1] for r in results],
                }
            )

    return files.select("path", "filename", "content").mapInPandas(
        run, "path string, filename string, text string, error string"
    )


def _attempt(call: Callable, content: bytes, name: str) -> tuple[str | None, str | None]:
    try:
        return call(content, name), None
    except Exception as failure:  # the row carries the error
        return None, f"Error processing {name}: {failure}"


def extract_fields(
    texts: DataFrame, make_extractor: Callable[[], Callable[[str], dict[str, str | None]]], key: str = "item_id"
) -> DataFrame:
    """Canonical fields of every text by an external model: key, all_text, fields, error."""
    schema = f"{key} {dict(texts.dtypes)[key]}, all_text string, fields map<string,string>, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = make_extractor()
        for batch in batches:
            fields, errors = [], []
            for value in batch["all_text"]:
                try:
                    fields.append(dict(extract(value)))
                    errors.append(None)
                except Exception as failure:  # the row carries the error
                    fields.append({})
                    errors.append(str(failure))
            yield batch.assign(fields=fields, error=errors)[[key, "all_text", "fields", "error"]]

    return texts.select(key, "all_text").mapInPandas(run, schema)


def extract_fields_offline(texts: DataFrame, key: str = "item_id") -> DataFrame:
    """Canonical fields from ``Field: value`` lines; the first line of a field counts."""
    names = [p for p in vocab.CANONICAL_PARAMETERS if p != "Reason for Change"]
    entries = []
    for name in names:
        found = F.regexp_extract("all_text", rf"(?im)^[ \t]*{name}[ \t]*:[ \t]*(\S.*?)[ \t\r]*$", 1)
        entries.extend([F.lit(name), F.nullif(found, F.lit(""))])
    return texts.select(key, "all_text", F.create_map(*entries).alias("fields"))


def plan_with(
    requests: DataFrame, make_planner: Callable[[], Callable[[str], dict | None]]
) -> DataFrame:
    """Retrieval plans by an external planner; a failed call leaves NULL queries.

    requests: request_id, question. The planner returns search_queries,
    third_search_justified and corpus_wide_requested.
    """
    schema = (
        f"request_id {dict(requests.dtypes)['request_id']}, question string, search_queries array<string>, "
        "third_search_justified boolean, corpus_wide_requested boolean"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planner = make_planner()
        for batch in batches:
            plans = []
            for question in batch["question"]:
                try:
                    plans.append(planner(question) or {})
                except Exception:  # no plan: the question itself is searched
                    plans.append({})
            yield pd.DataFrame(
                {
                    "request_id": batch["request_id"],
                    "question": batch["question"],
                    "search_queries": [p.get("search_queries") for p in plans],
                    "third_search_justified": [bool(p.get("third_search_justified")) for p in plans],
                    "corpus_wide_requested": [bool(p.get("corpus_wide_requested")) for p in plans],
                }
            )

    return requests.select("request_id", "question").mapInPandas(run, schema)


def plan_offline(requests: DataFrame) -> DataFrame:
    """Plans without a planner: the question is the only query."""
    return requests.select(
        "request_id",
        "question",
        F.array("question").alias("search_queries"),
        F.lit(False).alias("third_search_justified"),
        F.lit(False).alias("corpus_wide_requested"),
    )
