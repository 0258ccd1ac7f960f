"""Enquiry parameters: post-processing to long tables and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from worklens import vocab
from worklens.functions.dates import header_date
from worklens.functions.text import strip
from worklens.functions.values import clean_value, insulation_category, postcode_area

EXTRACTED = tuple(p for p in vocab.CANONICAL_PARAMETERS if p != "Reason for Change")


def _post_process(name: str, raw: Column, header: Column) -> Column:
    given = F.coalesce(F.nullif(strip(raw), F.lit("")), F.lit("Not provided"))
    if name == "Tapered Insulation":
        return insulation_category(given)
    if name == "Post Code":
        return postcode_area(given)
    if name == "Date Received":
        return F.coalesce(header["date_received"], given)
    if name == "Hour Received":
        return F.coalesce(header["hour_received"], given)
    return given


def canonical_parameters(answers: DataFrame, key: str = "item_id") -> DataFrame:
    """Long rows (key, parameter, value, source) of extracted fields.

    answers: key, all_text, fields (map by canonical name). The long form is
    one projection and one explode; nothing is shuffled.
    """
    # Bound by a generator, so that the header is searched once per text.
    header = F.explode(F.array(header_date("all_text"))).alias("_header")
    staged = answers.select(key, "fields", header)
    rows = [
        F.struct(
            F.lit(name).alias("parameter"),
            _post_process(name, F.col("fields")[name], F.col("_header")).alias("value"),
            F.lit("Email Content").alias("source"),
        )
        for name in EXTRACTED
    ]
    rows.append(
        F.struct(
            F.lit("Reason for Change").alias("parameter"),
            F.lit(vocab.REASON_FOR_CHANGE).alias("value"),
            F.lit("Business Rule").alias("source"),
        )
    )
    return staged.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.*")


def report_rows(parameters: DataFrame, key: str = "item_id") -> DataFrame:
    """Rows of the parameter table: canonical order first (``seq``), then other names."""
    order = F.create_map(*[F.lit(x) for i, p in enumerate(vocab.CANONICAL_PARAMETERS, 1) for x in (p, i)])
    return parameters.select(
        key,
        F.coalesce(F.try_element_at(order, F.col("parameter")), F.lit(999)).alias("seq"),
        "parameter",
        clean_value("value").alias("value"),
        F.coalesce("source", F.lit("")).alias("source"),
    )


def parameter_columns(parameters: DataFrame, names: dict[str, str], key: str = "item_id") -> DataFrame:
    """Wide form of a few parameters: ``{column: parameter}``."""
    wanted = parameters.filter(F.col("parameter").isin(*names.values()))
    return wanted.groupBy(key).agg(
        *[F.max(F.when(F.col("parameter") == p, F.col("value"))).alias(c) for c, p in names.items()]
    )
