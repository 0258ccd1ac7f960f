"""File-type predicates, size gate and the routing cascade of assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from worklens import vocab
from worklens.functions.text import col
from worklens.functions.values import lenient_size


def _lower(c: Column | str) -> Column:
    return F.lower(F.coalesce(col(c), F.lit("")))


def ends_with_any(c: Column | str, endings: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for ending in endings:
        out = out | col(c).endswith(ending)
    return out


def attachment_kind(filename: Column | str) -> Column:
    name = _lower(filename)
    images = (*vocab.IMAGE_ENDINGS, *vocab.PLACEHOLDER_IMAGE_ENDINGS)
    return (
        F.when(name.endswith(".pdf"), F.lit("attachment_pdf"))
        .when(ends_with_any(name, images), F.lit("attachment_image"))
        .otherwise("attachment_other")
    )


def is_csv(filename: Column | str, extension: Column | str, kind: Column | str) -> Column:
    return (col(kind) == "csv") | (_lower(extension) == ".csv") | _lower(filename).endswith(".csv")


def is_preview_pdf(filename: Column | str, extension: Column | str, kind: Column | str) -> Column:
    """Own preview PDFs in the csv column are stored but not read back."""
    pdf = (F.ltrim(_lower(extension), F.lit(".")) == "pdf") | _lower(filename).endswith(".pdf")
    return (col(kind) == "csv") & _lower(filename).startswith("ai_data_preview_") & pdf


def file_suffix(filename: Column | str) -> Column:
    """Lower-cased suffix with its dot; empty without one."""
    return F.regexp_extract(_lower(filename), r"[^/](\.[^./]+)$", 1)


def is_supported_email(filename: Column | str, extension: Column | str) -> Column:
    declared = F.trim(_lower(extension))
    declared = F.when((declared == "") | declared.startswith("."), declared).otherwise(F.concat(F.lit("."), declared))
    return file_suffix(filename).isin(*vocab.EMAIL_ENDINGS) | declared.isin(*vocab.EMAIL_ENDINGS)


def is_image(kind: Column | str, mime: Column | str, filename: Column | str) -> Column:
    """Images are hidden in source lists."""
    return (
        F.coalesce(col(kind) == "attachment_image", F.lit(False))
        | F.coalesce(col(mime).startswith("image/"), F.lit(False))
        | _lower(filename).rlike(r"\.(png|jpe?g|gif|bmp|webp)$")
    )


def exceeds_limit(size: Column | str, limit: int | None) -> Column:
    """Whether a parsed size is over the limit; without a limit none is."""
    if limit is None:
        return F.lit(False)
    return F.coalesce(lenient_size(size) > limit, F.lit(False))


def storage_gate(assets: DataFrame, limit: int, size: str = "file_size") -> DataFrame:
    """Adds the parsed size and the storage status, code and detail of assets over the store's limit."""
    parsed = lenient_size(size)
    over = exceeds_limit(size, limit)
    detail = F.format_string(vocab.OVERSIZE_DETAIL, parsed, F.lit(limit))
    return assets.select(
        "*",
        parsed.alias("size_bytes"),
        F.when(over, F.lit("unsupported")).otherwise("stored").alias("storage_status"),
        F.when(over, F.lit("object_too_large")).alias("storage_error_code"),
        F.when(over, detail).alias("storage_error_detail"),
    )


def route(
    filename: Column | str, extension: Column | str, kind: Column | str, size: Column | str, limit: int | None = None
) -> Column:
    """Processing route of an asset; the first matching rule decides. Assets over ``limit`` bytes are oversize."""
    name = _lower(filename)
    return (
        F.when(exceeds_limit(size, limit), F.lit("oversize"))
        .when(is_preview_pdf(filename, extension, kind), F.lit("preview"))
        .when(is_csv(filename, extension, kind), F.lit("csv"))
        .when(ends_with_any(name, vocab.EMAIL_ENDINGS) | (col(kind) == "email"), F.lit("email"))
        .when(name.endswith(".pdf"), F.lit("pdf"))
        .when(ends_with_any(name, vocab.IMAGE_ENDINGS), F.lit("image"))
        .when(ends_with_any(name, vocab.PLACEHOLDER_IMAGE_ENDINGS), F.lit("image_placeholder"))
        .otherwise("store_only")
    )


def placeholder_text(
    route_col: Column | str,
    filename: Column | str,
    actual_size: Column | str,
    max_pdf_bytes: int | None = None,
    max_image_bytes: int | None = None,
) -> Column:
    """Text that stands in for content that is not extracted; NULL when content is read.

    PDFs and images of any size are read unless the caller's extractor has a limit.
    """
    r, size = col(route_col), col(actual_size)
    return (
        F.when(
            (r == "pdf") & exceeds_limit(size, max_pdf_bytes),
            F.concat(F.lit("PDF too large for extraction ("), size.cast("string"), F.lit(" bytes).")),
        )
        .when(
            (r == "image") & exceeds_limit(size, max_image_bytes),
            F.concat(F.lit("Image too large for extraction ("), size.cast("string"), F.lit(" bytes).")),
        )
        .when(
            r == "image_placeholder",
            F.concat(F.lit("Unsupported image format: "), F.regexp_extract(_lower(filename), r"([^.]*)$", 1)),
        )
    )


def pdf_batches(files: DataFrame, key: str, size: str = "size_bytes") -> DataFrame:
    """Per mail: can its PDFs be extracted in one call (2-3 files, limited total)?"""
    pdf = files.filter(_lower("filename").endswith(".pdf"))
    return pdf.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_pdfs"),
        F.sum(size).cast("long").alias("total_bytes"),
        ((F.sum(size) <= vocab.MAX_BATCH_PDF_BYTES) & F.count(F.lit(1)).between(2, 3)).alias("batchable"),
    )
