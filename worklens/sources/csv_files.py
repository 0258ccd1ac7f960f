"""CSV assets of mixed dialects, taken apart by column functions: parameter tables and generic rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

REQUIRED = ("parameter", "value", "source")
#: The delimiters told apart; the one that the header line has most of is taken, of equal ones the first.
DELIMITERS = (",", ";", "\t", "|")

# Runs are possessive: a long cell or record is one step of the matcher.
_RECORD = r'(?:[^"\r\n]++|"(?:[^"]++|"")*+"?+)++'
_QUOTED = r'"(?:[^"]++|"")*+"?+'


def _cells(record: Column, delimiter: str) -> Column:
    """Cells of a record: quotes taken off, doubled quotes halved."""
    d = rf"\{delimiter}" if delimiter != "\t" else r"\t"
    # A delimiter in front makes every cell, the first and empty ones too, start with one.
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), record), F.lit(rf"{d}((?:{_QUOTED}|[^\"{d}]++)*+)"), F.lit(1))
    return F.transform(
        found,
        lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, r'^"|"(?=[^"]*$)', ""), F.lit('""'), F.lit('"'))).otherwise(c),
    )


def _per_delimiter(chosen: Column, make) -> Column:
    out = make(DELIMITERS[0])
    for d in DELIMITERS[1:]:
        out = F.when(chosen == d, make(d)).otherwise(out)
    return out


def _parsed(files: DataFrame) -> DataFrame:
    """path, header cells, delimiter and records of every readable file."""
    text = F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "")
    readable = files.filter(F.expr("is_valid_utf8(cast(content as string))"))
    records = readable.select("path", F.regexp_extract_all(text, F.lit(_RECORD), F.lit(0)).alias("_records"))
    head = F.regexp_replace(F.try_element_at("_records", F.lit(1)), _QUOTED, "")
    counts = F.array(*[F.length(head) - F.length(F.replace(head, F.lit(d), F.lit(""))) for d in DELIMITERS])
    best = F.array(*[F.lit(d) for d in DELIMITERS])[(F.array_position(counts, F.array_max(counts)) - 1).cast("int")]
    rows = records.filter(F.size("_records") > 0).withColumn("_delimiter", best)
    header = _per_delimiter(F.col("_delimiter"), lambda d: _cells(F.col("_records")[0], d))
    return rows.withColumn("_header", header)


def _keys(header: Column) -> Column:
    return F.transform(header, lambda h: F.lower(F.trim(h)))


def _is_parameter_table(header: Column) -> Column:
    return F.size(F.array_intersect(_keys(header), F.array(*[F.lit(n) for n in REQUIRED]))) == len(REQUIRED)


def _body(parsed: DataFrame) -> DataFrame:
    """Cells of the records behind the header, as an array of arrays."""
    body = F.slice("_records", 2, F.greatest(F.size("_records") - 1, F.lit(1)))
    cells = _per_delimiter(F.col("_delimiter"), lambda d: F.transform(body, lambda r: _cells(r, d)))
    return parsed.filter(F.size("_records") > 1).select("path", "_header", cells.alias("_cells"))


def parameter_rows(files: DataFrame) -> DataFrame:
    """Rows of parameter tables: path, row_index from 1 over the filled rows, parameter, value, source, text.

    files: path, content. Headers count trimmed and in any case; a missing cell is empty.
    A file is one asset; its records are the rows it emits. No shuffle.
    """
    parsed = _body(_parsed(files.select("path", "content")).filter(_is_parameter_table(F.col("_header"))))

    def cell(row: Column, name: str) -> Column:
        at = F.array_position(_keys(F.col("_header")), name).cast("int")
        return F.trim(F.coalesce(F.try_element_at(row, at), F.lit(""))).alias(name)

    named = F.transform("_cells", lambda row: F.struct(*[cell(row, n) for n in REQUIRED]))
    filled = F.filter(named, lambda r: F.concat(*[r[n] for n in REQUIRED]) != "")
    rows = parsed.select("path", F.posexplode(filled).alias("_at", "_row"))
    text = F.concat(
        F.lit("Parameter: "), "_row.parameter", F.lit(" | Value: "), "_row.value", F.lit(" | Source: "), "_row.source"
    )
    return rows.select("path", (F.col("_at") + 1).alias("row_index"), "_row.*", text.alias("text"))


def generic_rows(files: DataFrame) -> DataFrame:
    """Rows of all other CSV files as maps; all-blank rows are dropped.

    Cells beyond the header are joined under ``_rest``; of equal header names the last counts.
    """
    parsed = _body(_parsed(files.select("path", "content")).filter(~_is_parameter_table(F.col("_header"))))
    filled = F.filter("_cells", lambda row: F.exists(row, lambda c: F.trim(c) != ""))
    rows = parsed.select("path", "_header", F.posexplode(filled).alias("_at", "_row"))
    size = F.size("_header")
    pairs = F.zip_with("_header", F.slice("_row", F.lit(1), size), lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice("_header", i + 2, size), p["k"]))
    rest = F.slice("_row", size + 1, F.greatest(F.size("_row") - size, F.lit(1)))
    more = F.when(F.size("_row") > size, F.array(F.struct(F.lit("_rest").alias("k"), F.array_join(rest, ";").alias("v"))))
    entries = F.concat(last, F.coalesce(more, F.array().cast("array<struct<k:string,v:string>>")))
    return rows.select("path", (F.col("_at") + 1).alias("row_index"), F.map_from_entries(entries).alias("fields"))


def unreadable(files: DataFrame) -> DataFrame:
    """Files that are not UTF-8, with the reason; they end no job and give no rows."""
    bad = files.filter(~F.expr("is_valid_utf8(cast(content as string))"))
    return bad.select("path", F.lit("not_utf8").alias("error"))


def read_uniform_parameters(spark: SparkSession, path: str) -> DataFrame:
    """Parameter tables with one known layout (comma, header): Spark's own reader."""
    rows = (
        spark.read.schema("Parameter string, Value string, Source string")
        .option("header", True)
        .option("escape", '"')
        .csv(path)
    )
    trimmed = rows.select(
        F.col("_metadata.file_path").alias("path"),
        *[F.trim(F.coalesce(c, F.lit(""))).alias(c.lower()) for c in ("Parameter", "Value", "Source")],
    )
    return trimmed.filter((F.length("parameter") > 0) | (F.length("value") > 0) | (F.length("source") > 0))
