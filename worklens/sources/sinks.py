"""Sinks: parameter tables, their manifest, event log lines, table swaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from worklens.functions import keys
from worklens.sources.named_files import write_named_files


def artifact_manifest(
    identities: DataFrame,
    item: str = "item_id",
    revision: str = "input_revision",
    version: str = "pipeline_version",
    board: Column | str = "board_id",
) -> DataFrame:
    """File name and object key of the three artifacts of every identity."""
    names = keys.artifact_filenames(item, revision, version)
    rows = identities.select(
        F.col(item).alias("item_id"),
        F.col(revision).alias("input_revision"),
        F.col(version).alias("pipeline_version"),
        (F.col(board) if isinstance(board, str) else board).alias("board_id"),
        names.alias("_n"),
    )
    kinds = F.explode(
        F.array(
            *[
                F.struct(F.lit(kind).alias("artifact_kind"), F.col(f"_n.{kind}").alias("filename"))
                for kind in ("ai_data", "ai_data_pdf", "match_report")
            ]
        )
    )
    return rows.withColumn("k", kinds).select(
        "item_id",
        "board_id",
        "k.artifact_kind",
        "k.filename",
        keys.artifact_object_key("board_id", "item_id", "input_revision", "pipeline_version", "k.filename").alias("object_key"),
    )


def write_parameter_tables(rows: DataFrame, path: str, item: str = "item_id") -> None:
    """One ``Parameter,Value,Source`` file per item, rows in report order.

    Items are spread over the tasks by hash, so each item is one file.
    """
    out = rows.repartition(item).sortWithinPartitions(item, "seq", "parameter")
    out.select(
        item,
        F.col("parameter").alias("Parameter"),
        F.col("value").alias("Value"),
        F.col("source").alias("Source"),
    ).write.partitionBy(item).option("header", True).option("escape", '"').option("lineSep", "\r\n").option(
        "emptyValue", ""
    ).mode("errorifexists").csv(path)


def write_parameter_files(rows: DataFrame, path: str, filename: str = "filename", overwrite: bool = False) -> None:
    """``Parameter,Value,Source`` tables under the file names that the rows carry, in report order.

    rows: filename, seq, parameter, value, source. A failed job leaves no file behind; see ``write_named_files``.
    """
    options = {"escape": '"', "emptyValue": ""}
    record = F.to_csv(F.struct("parameter", "value", "source"), options)
    lines = rows.select(filename, F.col("seq").cast("long").alias("seq"), "parameter", record.alias("line"), F.lit(1).alias("part"))
    # The header is a row of every file as well, before all others.
    heads = rows.select(filename).distinct().select(
        filename, F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("parameter"), F.lit("Parameter,Value,Source").alias("line"), F.lit(0).alias("part")
    )
    write_named_files(heads.unionByName(lines), path, filename, "line", ["part", "seq", "parameter"], overwrite)


def write_log(lines: DataFrame, path: str, line: str = "line") -> None:
    lines.select(F.col(line).alias("value")).write.mode("append").text(path)
