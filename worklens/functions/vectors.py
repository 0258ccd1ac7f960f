"""Vector rules on ``array<float>`` / ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from worklens.functions.text import col


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(a: Column | str) -> Column:
    """Unit vector; a zero vector is returned unchanged."""
    vector = col(a).cast("array<double>")
    scaled = F.transform(
        F.array(F.struct(vector.alias("v"), norm(vector).alias("n"))),
        lambda b: F.when(b["n"] == 0, b["v"]).otherwise(F.transform(b["v"], lambda x: x / b["n"])),
    )
    return scaled[0]


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """``1 - cos``; NaN when a vector is zero, so that it sorts last."""
    scale = norm(a) * norm(b)
    return F.coalesce(1.0 - F.try_divide(dot(a, b), scale), F.lit(float("nan")))
