"""Sharding: a keyed permutation of global row numbers gives a computable shard and slot."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from worklens.session import written

#: A prime below 2^31: products of two remainders stay within 64 bits.
PRIME = 2_147_483_647
ROUNDS = 6


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Multiplier and two summands of each round, from the seed."""
    keys = []
    for i in range(rounds):
        digest = hashlib.sha256(f"{seed}/{i}".encode()).digest()
        m, a, b = (int.from_bytes(digest[j : j + 8], "big") for j in (0, 8, 16))
        keys.append((1 + m % (PRIME - 1), a % PRIME, b % PRIME))
    return keys


def side_length(n: int) -> int:
    """The least side of a square with at least ``n`` cells."""
    return math.isqrt(n - 1) + 1 if n > 1 else 1


def permuted_once(number: int, side: int, keys: list[tuple[int, int, int]]) -> int:
    """One application of the network in plain integers."""
    left, right = divmod(number, side)
    for m, a, b in keys:
        t = (right % PRIME * m + a) % PRIME
        left, right = right, (left + (t * t + b) % PRIME) % side
    return left * side + right


def permuted(number: int, n: int, seed: int) -> int:
    """Where row ``number`` of ``n`` goes; the same arithmetic as the columns below."""
    side, keys = side_length(n), round_keys(seed)
    number = permuted_once(number, side, keys)
    while number >= n:
        number = permuted_once(number, side, keys)
    return number


def _network(df: DataFrame, position: str, side: int, keys: list[tuple[int, int, int]], outside: int) -> DataFrame:
    """The position after one pass of the network where it is at or beyond ``outside``."""
    df = df.withColumns({"_left": F.expr(f"`{position}` div {side}"), "_right": F.col(position) % side})
    for m, a, b in keys:
        t = (F.col("_right") % PRIME * F.lit(m).cast("long") + F.lit(a).cast("long")) % PRIME
        df = df.withColumn("_t", t)
        turned = (F.col("_left") + (F.col("_t") * F.col("_t") + F.lit(b).cast("long")) % PRIME) % side
        df = df.withColumns({"_left": F.col("_right"), "_right": turned})
    moved = F.col("_left") * side + F.col("_right")
    return df.withColumn(position, F.when(F.col(position) >= outside, moved).otherwise(F.col(position))).drop(
        "_left", "_right", "_t"
    )


def longest_walk(spark, n: int, seed: int) -> int:
    """How often the network has to be applied until every position lies below ``n``.

    Only the cells of the square beyond ``n`` - at most twice its side - can need
    more than one step; they are walked here, as a table, until none is left.
    """
    side, keys, steps = side_length(n), round_keys(seed), 1
    left = spark.range(n, side * side).withColumnRenamed("id", "position")
    while steps <= side * side - n:
        # Filtered after writing: pushed down, the filter would repeat all rounds in itself.
        left = written(_network(left, "position", side, keys, 0), "walks").filter(F.col("position") >= n)
        if left.isEmpty():
            break
        steps += 1
    return steps + 1 if side * side > n else 1


def with_permuted(df: DataFrame, number: str, n: int, seed: int, into: str = "position") -> DataFrame:
    """The permuted row number: a bijection of 0..n-1, the same in every run."""
    if n <= 0:
        return df.withColumn(into, F.col(number))
    side, keys = side_length(n), round_keys(seed)
    out = _network(df.withColumn(into, F.col(number)), into, side, keys, 0)
    for _ in range(longest_walk(df.sparkSession, n, seed) - 1):
        out = _network(out, into, side, keys, n)
    return out


def with_row_numbers(df: DataFrame, order: list[Column], name: str = "row_number") -> tuple[DataFrame, int]:
    """Gapless global numbers from 0 in the given order, and the number of rows.

    Rows are dealt by range and numbered inside their range; only one count per
    range meets in a window. Rows equal in the whole order are alike and take
    their numbers among themselves.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("_range"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"), F.col("_rows")
    )
    starts = written(starts, "range-starts")
    n = starts.agg(F.sum("_rows")).first()[0] or 0
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    numbered = ranged.withColumn("_local", local).join(starts.drop("_rows"), "_range")
    return numbered.withColumn(name, (F.col("_local") + F.col("_start")).cast("long")).drop("_range", "_local", "_start"), n


def shard_documents(
    docs: DataFrame,
    shards: int,
    seed: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    overhead: int = 16,
) -> DataFrame:
    """Shard and slot of every row: (doc_id, size, text_crc32, row_number, position, shard, slot).

    Rows are numbered by (doc_id, CRC-32, size), ids that are null first. Position is
    the permuted row number; shard is its remainder by ``shards`` and slot its
    quotient, so shard sizes differ by one row at most, slots have no gaps, and both
    can be computed for any row number without the table. Null texts have size
    ``overhead`` and the CRC-32 of no bytes. Repeated rows get a number each.
    Columns of other names are not looked at. An empty table gives an empty table.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + overhead).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    numbered, n = with_row_numbers(written(rows, "row-sizes"), order)
    placed = with_permuted(numbered, "row_number", n, seed)
    return placed.withColumns(
        {"shard": (F.col("position") % shards).cast("int"), "slot": F.expr(f"position div {shards}")}
    )
