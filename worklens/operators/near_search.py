"""Search over cells of similar vectors: approximate with a few cells, exact by a bound on the others."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from worklens.operators.retrieval import search
from worklens.plans.lifecycle import KEY
from worklens.scale import top_k
from worklens.session import written

#: The cell of vectors without a direction.
NOWHERE = -1
#: What rounding may do to a distance.
SLACK = 1e-6


def cell_centres(chunks: DataFrame, cells: int, sample: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centres of up to ``cells`` groups of directions, fitted on up to ``sample`` vectors.

    Only the centres depend on the sample - the chunks whose ids hash lowest; every chunk is put
    into a cell, so none is lost, however bad the fit.
    """
    rows = chunks.select("chunk_id", F.col("embedding").cast("array<double>").alias("v")).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample)
    vectors = [r["v"] for r in rows.collect() if r["v"]]
    unit = _unit(np.array(vectors, dtype=float)) if vectors else np.zeros((0, 1))
    unit = np.unique(unit[np.abs(unit).sum(axis=1) > 0], axis=0)
    if not len(unit):
        return unit
    centres = unit[np.random.default_rng(seed).permutation(len(unit))[:cells]]
    for _ in range(rounds):
        near = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        full = np.abs(sums).sum(axis=1) > 0
        centres[full] = _unit(sums[full])
    return centres


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def in_cells(chunks: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds the nearest cell of every chunk and its distance (``_cell``, ``_far``) on the unit sphere."""
    bundle = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])

    @F.pandas_udf(bundle)
    def nearest(embedding: pd.Series) -> pd.DataFrame:
        if not len(embedding):
            return pd.DataFrame({"cell": pd.Series(dtype="int32"), "far": pd.Series(dtype="float64")})
        unit = _unit(np.stack(embedding.to_numpy()).astype(float))
        lost = ~(np.abs(unit).sum(axis=1) > 0) | ~np.isfinite(unit).all(axis=1)
        if not len(centres):
            return pd.DataFrame({"cell": np.full(len(unit), NOWHERE, np.int32), "far": np.zeros(len(unit))})
        like = np.nan_to_num(unit) @ centres.T
        cell = like.argmax(axis=1)
        far = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * like[np.arange(len(cell)), cell]))
        return pd.DataFrame({"cell": np.where(lost, NOWHERE, cell).astype(np.int32), "far": np.where(lost, 0.0, far)})

    placed = chunks.withColumn("_place", nearest(F.col("embedding").cast("array<double>")))
    return placed.select(*chunks.columns, F.col("_place.cell").alias("_cell"), F.col("_place.far").alias("_far"))


def near_search(
    chunks: DataFrame, queries: DataFrame, k: int, *, cells: int = 64, probes: int = 4, sample: int = 4096, exact: bool = True
) -> DataFrame:
    """Cosine top-k chunks of every query inside its task; columns and rows as ``retrieval.search``.

    Each query is first compared with the chunks of its ``probes`` nearest cells. With ``exact`` it then
    also meets the chunks of every other cell that can hold a nearer one than the k-th found - a
    chunk is at least as far as its cell's centre less the cell's radius - so the result is that of the exact search.
    Without it the first comparison is the answer: a share of the exact one that grows with ``probes``.
    The centres (``cells`` x width numbers) and cell radii are what the workers and the plan get.
    """
    centres = cell_centres(chunks, cells, sample)
    asked = written(queries, "near-queries")
    placed = in_cells(chunks.join(asked.select(KEY).distinct(), KEY, "left_semi"), centres)
    placed = written(placed, "cells")
    # One row per task and cell.
    known = written(placed.groupBy(KEY, F.col("_cell")).agg(F.max("_far").alias("_radius")), "cell-radii")

    schema = T.ArrayType(T.DoubleType())

    @F.pandas_udf(schema)
    def distances(vector: pd.Series) -> pd.Series:
        """Distance of each query to every centre, on the unit sphere; none for one without a direction."""
        out = []
        for v in vector:
            unit = _unit(np.array([v], dtype=float))[0]
            there = np.isfinite(unit).all() and np.abs(unit).sum() > 0 and len(centres)
            out.append(np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (centres @ unit))) if there else None)
        return pd.Series(out, dtype=object)

    ids = ["request_id", "query_index"]
    placed_queries = asked.withColumn("_to", distances(F.col("vector").cast("array<double>")))
    each = placed_queries.join(known, KEY)
    centre = F.when(F.col("_cell") >= 0, F.get("_to", F.col("_cell")))
    least = F.greatest(centre - F.col("_radius") - SLACK, F.lit(0.0))
    # Cosine distance is half the squared distance of unit vectors.
    each = written(each.select(*asked.columns, "_cell", centre.alias("_near"), (least * least / 2).alias("_bound")), "query-cells")
    rank = F.rank().over(Window.partitionBy(*ids).orderBy(F.col("_near").asc_nulls_last(), "_cell"))
    ranked = each.withColumn("_rank", rank)
    probed = ranked.filter((F.col("_rank") <= probes) & F.col("_near").isNotNull())
    first = written(_within(placed, probed, k), "probed")
    if not exact:
        return first
    held = first.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n"), F.max("score").alias("_worst"))
    rest = ranked.join(held, ids, "left").filter((F.col("_rank") > probes) | F.col("_near").isNull())
    open_ = F.coalesce(F.col("_n"), F.lit(0)) < k
    # Chunks without a direction come after all others: they count only where there are too few.
    open_ = open_ | F.isnan("_worst") | (F.col("_bound") <= F.col("_worst") + SLACK)
    more = _within(placed, rest.filter(open_), k)
    both = first.drop("cand_pos").unionByName(more.drop("cand_pos"))
    return top_k(both, ids, [F.col("score"), F.col("chunk_id")], k, "cand_pos")


def _within(placed: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The exact search, each cell of a task as a task of its own."""
    cell = F.concat_ws("/", F.col("_cell").cast("string"), F.col(KEY)).alias(KEY)
    return search(placed.select(cell, "chunk_id", "embedding"), asked.select(cell, "request_id", "query_index", "vector"), k)
