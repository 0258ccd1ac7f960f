"""Exact top-k by inner product: branch and bound over blocks of dimensions in vertical layout."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from worklens.session import written

LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


def usable(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & good


def vertical(ids: list[int], vectors: np.ndarray, width: int) -> dict:
    """One block of candidates: columns of dimensions, and the squared mass of each dimension block."""
    columns = np.ascontiguousarray(vectors.T)
    masses = np.stack([(columns[d : d + width] ** 2).sum(axis=0) for d in range(0, len(columns), width)] or [np.zeros(len(ids))])
    return {"ids": np.asarray(ids, dtype=np.int64), "columns": columns, "masses": masses}


def best_of_block(query: np.ndarray, own: int | None, block: dict, k: int, width: int, seed_rows: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the block's ``k`` best candidates for one query.

    Dimension blocks are taken in falling order of the query's mass. After each,
    a candidate stays only if its score so far plus the largest product that the
    remaining masses allow (Cauchy-Schwarz) reaches the k-th best score known;
    survivors are compacted, so later blocks touch fewer rows. Ties stay.
    """
    ids, columns, masses = block["ids"], block["columns"], block["masses"]
    alive = np.arange(len(ids)) if own is None else np.flatnonzero(ids != own)
    if not len(alive):
        return ids[:0], np.zeros(0)
    starts = list(range(0, len(query), width))
    query_mass = np.array([(query[d : d + width] ** 2).sum() for d in starts])
    order = np.argsort(-query_mass, kind="stable")
    floor = -np.inf
    if len(alive) > k:
        first = query @ columns[:, alive[: max(seed_rows, k)]]
        floor = np.partition(first, len(first) - k)[len(first) - k]
    # Scores are whole numbers; the slack covers the rounding of the bounds.
    slack = 0.5 + 1e-9 * np.sqrt(query_mass.sum() * masses.sum(axis=0).max())
    scores, rest, query_rest = np.zeros(len(alive)), masses[:, alive].sum(axis=0), query_mass.sum()
    for b in order.tolist():
        d = starts[b]
        scores = scores + query[d : d + width] @ columns[d : d + width][:, alive]
        rest, query_rest = rest - masses[b, alive], query_rest - query_mass[b]
        reach = np.sqrt(np.maximum(rest, 0.0) * max(query_rest, 0.0)) * (1 + 1e-9)
        if len(alive) > k:
            certain = scores - reach
            floor = max(floor, np.partition(certain, len(certain) - k)[len(certain) - k])
            stay = scores + reach >= floor - slack
            if not stay.all():
                alive, scores, rest = alive[stay], scores[stay], rest[stay]
    top = np.lexsort((ids[alive], -scores))[:k]
    return ids[alive[top]], scores[top]


def exact_best(query: list[int], own: int | None, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[list[int], list[int]]:
    """The same in unbounded integers, for components whose products leave the exact range of doubles."""
    scored = []
    for i, vector in zip(ids.tolist(), vectors):
        if i != own:
            score = sum(int(a) * int(b) for a, b in zip(query, vector))
            scored.append((-min(max(score, LONG_MIN), LONG_MAX), i))
    scored.sort()
    return [i for _, i in scored[:k]], [-s for s, _ in scored[:k]]


def top_k(
    candidates: DataFrame,
    queries: DataFrame,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    width: int = 8,
    candidate_rows: int = 16384,
    query_rows: int = 512,
) -> DataFrame:
    """The ``k`` best candidates of every query by inner product: (query_id, rank, vec_id, score).

    Vectors hold whole numbers as doubles. A query never meets the row of its own id;
    ties go to the smaller id; a query with fewer candidates gets all of them. Rows
    whose id or vector is null, or whose vector has a null or non-finite component,
    take no part; vectors of another length than the query's are no candidates for
    it. Repeated rows each count as a candidate, and a repeated query is answered
    once. An empty side gives no rows. Other columns are not looked at. Scores are
    exact whole numbers; beyond the range of a long they stop at its ends.

    Candidates are packed into blocks of columns once. Every block meets every block
    of queries of its length (a search of all queries against all rows needs each
    such pair), prunes inside, and sends on k rows per query; no pair of rows is kept.
    """
    def prepared(df: DataFrame) -> DataFrame:
        vectors = F.transform(F.col(vector), lambda x: x.cast("double"))
        rows = df.select(F.col(vec_id).cast("long").alias("id"), vectors.alias("vector"))
        return rows.filter(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("dims", F.size("vector"))

    left = prepared(candidates)
    right = prepared(queries).dropDuplicates(["id", "dims"])
    spark = candidates.sparkSession

    def packed(df: DataFrame, rows: int, name: str) -> tuple[DataFrame, int]:
        n = max(1, -(-df.count() // rows))
        # Equal ids and vectors are spread by their place, not by their value.
        part = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n)) if n > 1 else F.lit(0)

        def pack(key: tuple, group: pa.Table) -> pa.Table:
            dims = key[1].as_py()
            flat = group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return pa.table(
                {
                    "part": pa.array([key[0].as_py()], pa.int64()),
                    "dims": pa.array([dims], pa.int32()),
                    "ids": pa.array([group.column("id").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                    "body": pa.array([np.ascontiguousarray(flat, dtype=np.float64).tobytes()], pa.binary()),
                }
            )

        blocks = df.withColumn("part", part.cast("long")).groupBy("part", "dims").applyInArrow(
            pack, "part long, dims int, ids binary, body binary"
        )
        return written(blocks, name), n

    blocks, n_blocks = packed(left, candidate_rows, "candidate-blocks")
    asked, _ = packed(right, query_rows, "query-blocks")
    asked = asked.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("part"),
        "dims",
        F.col("ids").alias("query_ids"),
        F.col("body").alias("query_body"),
    )
    work = asked.repartition(max(spark.sparkContext.defaultParallelism, n_blocks), "part", F.xxhash64("query_ids"))
    work = work.join(blocks, ["part", "dims"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dims = row["dims"]
                ids, query_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["query_ids"], np.int64)
                vectors = np.frombuffer(row["body"]).reshape(len(ids), dims)
                asks = np.frombuffer(row["query_body"]).reshape(len(query_ids), dims)
                most = max(1.0, np.abs(vectors).max(initial=0)) * max(1.0, np.abs(asks).max(initial=0)) * max(1, dims)
                block = vertical(ids, vectors, width) if most < 2**52 else None
                out: list[tuple] = []
                for own, query in zip(query_ids.tolist(), asks):
                    if block is not None:
                        got, scores = best_of_block(query, own, block, k, width)
                        out += [(own, i, int(s)) for i, s in zip(got.tolist(), scores.tolist())]
                    else:
                        out += [(own, i, s) for i, s in zip(*exact_best(query.tolist(), own, ids, vectors, k))]
                yield pa.RecordBatch.from_pandas(
                    pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64"), preserve_index=False
                )

    found = work.mapInArrow(search, "query_id long, vec_id long, score long")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
