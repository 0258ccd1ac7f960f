"""Results of an expensive stage, kept by content and version: what was computed once is not computed again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from worklens.session import read_if_there

#: Name of the content hash in the frames that a stage gets and gives.
HASH = "content_hash"


def stored_results(spark: SparkSession, path: str, version: str) -> DataFrame | None:
    """One result per content hash of a version; None before the first one."""
    rows = read_if_there(spark, f"{path}/version={version}")
    # Two runs side by side can have computed the same content.
    return None if rows is None else rows.drop("part").dropDuplicates([HASH])


def cached(df: DataFrame, content: str, version: str, path: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``df`` with the columns that ``compute`` makes of their ``content``.

    ``compute`` gets (content_hash, ``content``), each content once and only those that no run of this ``version``
    has stored under ``path``, and returns content_hash with new columns. Its results are stored in a folder of
    their own when they are complete, so an interrupted run leaves nothing behind. Null contents get null columns.
    A version names everything the result depends on besides the content (model, prompt, code).
    """
    spark = df.sparkSession
    asked = df.select(F.sha2(F.col(content).cast("binary"), 256).alias(HASH), F.col(content)).filter(F.col(HASH).isNotNull()).dropDuplicates([HASH])
    known = stored_results(spark, path, version)
    unseen = asked if known is None else asked.join(known.select(HASH), HASH, "left_anti")
    computed = compute(unseen)
    if HASH not in computed.columns:
        raise ValueError(f"the stage must keep {HASH}")
    computed.drop(content).write.parquet(f"{path}/version={version}/part={uuid.uuid4().hex}")
    results = stored_results(spark, path, version)
    clash = set(results.columns) & set(df.columns)
    if clash:
        raise ValueError(f"columns of the stage are there already: {sorted(clash)}")
    keyed = df.withColumn(HASH, F.sha2(F.col(content).cast("binary"), 256))
    return keyed.join(results, HASH, "left").drop(HASH)
