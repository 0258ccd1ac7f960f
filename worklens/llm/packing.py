"""Best-fit packing of whole documents into bins of several permitted sequence lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from worklens.llm.common import WORD
from worklens.session import written

def sequence_cost(capacity: int, overhead: int = 64, quadratic_from: int = 16384) -> float:
    """Cost of a bin: linear work, attention that grows with the square, and an overhead for each sequence."""
    return capacity + capacity * capacity / quadratic_from + overhead


def best_fit(
    sizes: Sequence[int], capacities: Sequence[int], cost: Callable[[int], float] = sequence_cost
) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and the capacity of each bin.

    Pieces are taken by falling size (ties by position). A piece goes into the open
    bin that it fills best (ties: the bin opened first). If none has room, a bin is
    opened of the permitted size with the least cost per token that can fill it: the
    piece itself, and what is left to pack (ties: the smaller). Last, each bin shrinks
    to the least permitted size that holds its contents.
    """
    allowed = sorted(set(capacities))
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    filled: list[int] = []
    room: list[tuple[int, int]] = []  # (free tokens, bin), sorted
    remaining = sum(sizes)
    for i in order:
        size = sizes[i]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, chosen = room.pop(at)
        else:
            fitting = [c for c in allowed if c >= size]
            free = min(fitting, key=lambda c: (cost(c) / max(1, min(c, remaining)), c))
            chosen = len(filled)
            filled.append(0)
        bins[i], offsets[i] = chosen, filled[chosen]
        filled[chosen] += size
        remaining -= size
        insort(room, (free - size, chosen))
    return bins, offsets, [allowed[bisect_left(allowed, f)] for f in filled]


def word_tokens(text: Column) -> Column:
    """Words of the text and one end token."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)) + 1).cast("long")


def pack(
    docs: DataFrame,
    capacities: Sequence[int] = (512, 1024, 2048, 4096, 8192),
    doc_id: str = "doc_id",
    tokens: Column | None = None,
    text: str = "text",
    group_pieces: int = 4096,
    cost: Callable[[int], float] = sequence_cost,
) -> DataFrame:
    """Where every token of every document goes.

    Result: (doc_id, piece, start, length, pack_group, bin, bin_offset, capacity): tokens
    ``start`` to ``start + length`` of the document lie at ``bin_offset`` of the bin
    (pack_group, bin), which has the permitted length ``capacity``. ``tokens`` gives the
    length of a document, by default its words and an end token, so null and empty
    texts have length 1; lengths that are null or below 1 count as 1. Documents longer
    than the largest capacity are cut into full pieces and a rest; nothing is left out.
    Repeated rows are packed as often as they occur. Other columns are not looked at.

    Pieces are dealt by hash into groups of about ``group_pieces``, packed on their own,
    so the work of a task is bounded; a group leaves about one bin partly filled.
    """
    largest = max(capacities)
    size = F.greatest(F.coalesce(tokens if tokens is not None else word_tokens(F.col(text)), F.lit(1)), F.lit(1)).cast("long")
    lengths = docs.select(F.col(doc_id).alias("doc_id"), size.alias("_tokens"))
    pieces = lengths.select(
        "doc_id",
        "_tokens",
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_tokens - 1) div {largest}"))).alias("piece"),
    ).select(
        "doc_id",
        "piece",
        (F.col("piece") * largest).alias("start"),
        F.least(F.lit(largest).cast("long"), F.col("_tokens") - F.col("piece") * largest).alias("length"),
        F.monotonically_increasing_id().alias("_place"),
    )
    pieces = written(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    # The place tells repeated rows apart, which would else meet in one group.
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "_place"), F.lit(groups)).cast("int"))

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("_place", "ascending")])
        bins, offsets, sizes = best_fit(group.column("length").to_pylist(), capacities, cost)
        return (
            group.drop_columns(["_place"])
            .append_column("bin", pa.array(bins, pa.int32()))
            .append_column("bin_offset", pa.array(offsets, pa.int64()))
            .append_column("capacity", pa.array([sizes[b] for b in bins], pa.int64()))
        )

    kind = dict(docs.select(F.col(doc_id).alias("doc_id")).dtypes)["doc_id"]
    return dealt.groupBy("pack_group").applyInArrow(
        packed,
        f"doc_id {kind}, piece long, start long, length long, pack_group int, bin int, bin_offset long, capacity long",
    )
