"""Bounded samples of labelled documents, and models fitted on them by one executor task."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from worklens.session import written


def _lowest(rows: DataFrame, order: list[Column], per_label: int) -> DataFrame:
    """Up to ``per_label`` rows of every label, those that come first; a limit stands in front of the shuffle."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= per_label).drop("_rank")


def _few(marks: DataFrame, per_label: int) -> DataFrame:
    """The ``per_label`` lowest keys of every label, written: few labels make few groups, so they are ranked in parts first."""
    order = [F.xxhash64("key"), F.col("key")]
    parted = marks.select("key", "label").dropna().distinct().withColumn("_part", F.pmod(order[0], F.lit(64)))
    rank = F.row_number().over(Window.partitionBy("label", "_part").orderBy(*order))
    parted = parted.withColumn("_rank", rank).filter(F.col("_rank") <= per_label).select("key", "label")
    return written(_lowest(parted, order, per_label), "sample-keys")


def labelled_rows(rows: DataFrame, per_label: int) -> DataFrame:
    """(doc_id, label, text) of up to ``per_label`` rows of every label, those whose id and text hash lowest.

    ``rows`` has these columns; each row is known by its own label. First keys alone are ranked; the few chosen
    pick their rows out of one more scan, and rows are ranked once more, so repeated rows do not
    make the sample larger. Null labels are left out.
    """
    keyed = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    return _picked(keyed, _few(keyed, per_label), ["key", "label"], per_label)


def labelled_documents(docs: DataFrame, marks: DataFrame, per_label: int) -> DataFrame:
    """(doc_id, label, text) of up to ``per_label`` rows of every label, with the labels of another table.

    ``docs`` has doc_id and text, ``marks`` doc_id and label. Ids that hash lowest are chosen; an id that many
    documents bear does not make the sample larger. Null ids and labels are left out.
    """
    chosen = _few(marks.select(F.col("doc_id").alias("key"), "label"), per_label)
    return _picked(docs.select(F.col("doc_id").alias("key"), "doc_id", "text"), chosen, ["key"], per_label)


def _picked(rows: DataFrame, chosen: DataFrame, on: list[str], per_label: int) -> DataFrame:
    order = [F.xxhash64("key"), F.col("key"), F.col("text")]
    met = rows.join(chosen, on)
    return _lowest(met, order, per_label).select("doc_id", "label", "text")


def fitted(sample: DataFrame, build: Callable[[pa.Table], Any]) -> Any:
    """What ``build`` makes of a bounded sample, computed by one executor task; None for an empty sample.

    Only the model comes back to the driver, pickled; its size is that of its weights.
    """

    def run(rows: pa.Table) -> pa.Table:
        return pa.table({"model": pa.array([pickle.dumps(build(rows), protocol=5)], pa.binary())})

    made = sample.withColumn("_all", F.lit(1)).groupBy("_all").applyInArrow(run, "model binary").first()
    return None if made is None else pickle.loads(made[0])
