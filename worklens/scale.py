"""Building blocks that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from worklens.session import written


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str | None = None,
) -> DataFrame:
    """The first ``k`` rows of every key.

    The rank filter lets Spark put a group limit in front of the shuffle, so a
    hot key sends at most ``k`` rows per input partition to its final task.
    """
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the given order."""
    return top_k(df, keys, order, 1)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "row_index",
) -> DataFrame:
    """``row_number`` per key for groups too large for one task.

    Rows are range-partitioned on (keys, order), which cuts a hot key into
    slices; each slice is numbered alone and shifted by the rows of the key in
    earlier slices. Only one count per (key, slice) meets in a window. The order
    must be total, otherwise equal rows are numbered arbitrarily.
    """
    slices = df.repartitionByRange(*[F.col(key) for key in keys], *order)
    slices = written(slices.withColumn("_slice", F.spark_partition_id()), "numbered-slices")
    group = [*keys, "_slice"]
    sizes = slices.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(key).alias(f"_k{i}") for i, key in enumerate(keys)],
        F.col("_slice").alias("_offset_slice"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
    )
    local = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    on = F.col("_slice") == F.col("_offset_slice")
    for i, key in enumerate(keys):
        on = on & F.col(key).eqNullSafe(F.col(f"_k{i}"))
    numbered = slices.withColumn("_local", local).join(offsets, on)
    return numbered.select(*df.columns, (F.col("_local") + F.col("_offset")).cast("int").alias(name))




def join_in_parts(left: DataFrame, right: DataFrame, keys: Sequence[str], rows_per_part: int) -> DataFrame:
    """Inner join on ``keys`` that cuts the right rows of a hot key into parts of about ``rows_per_part``.

    The left rows of such a key go to each of its parts. Only keys with more rows are counted out and
    joined to both sides, so an ordinary table costs one aggregation more.
    """
    sizes = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > rows_per_part)
    hot = written(sizes.select(*keys, F.ceil(F.col("_rows") / rows_per_part).cast("int").alias("_parts")), "hot-keys")
    if hot.isEmpty():
        return left.join(right, list(keys))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = right.join(hot, list(keys), "left").withColumn("_part", F.pmod(F.xxhash64(*right.columns), parts).cast("int")).drop("_parts")
    spread = left.join(hot, list(keys), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return spread.join(dealt, [*keys, "_part"]).drop("_part")
