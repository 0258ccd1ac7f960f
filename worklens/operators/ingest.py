"""Ingest: documents to overlapping chunks, statistics, upserts, mail assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from worklens import vocab
from worklens.functions import keys, text
from worklens.operators.routing import attachment_kind, exceeds_limit, placeholder_text
from worklens.sources.items import column_text


def chunk_documents(documents: DataFrame, max_chars: int | None = None, max_chunks: int | None = None) -> DataFrame:
    """Chunk rows of documents: file_id, kind, section, page, text.

    A narrow projection: no shuffle, and the text is read once. Chunk ids are
    derived from file, section and position, so a re-run gives the same ids.
    """
    cut = text.chunks("text", max_chars=max_chars, max_chunks=max_chunks)
    rows = documents.select("file_id", "kind", "section", "page", F.explode(cut).alias("c"))
    label = text.section_label("section", "kind", "c.chunk_index", "c.chunk_start", "c.chunk_end", "c.chunk_total")
    return rows.select(
        F.sha2(
            F.concat_ws("\x1f", F.col("file_id").cast("string"), F.coalesce("section", F.lit("")), F.coalesce(F.col("page").cast("string"), F.lit("")), F.col("c.chunk_index").cast("string")),
            256,
        ).alias("id"),
        "file_id",
        "kind",
        "page",
        label.alias("section"),
        "c.chunk_index",
        F.col("c.chunk_text").alias("chunk_text"),
    )


def document_statistics(documents: DataFrame, item: str = "item_id") -> DataFrame:
    """Per item: documents, chunks and documents per kind."""
    n = F.length(text.strip(text.without_nul("text")))
    stride = float(vocab.CHUNK_SIZE - vocab.CHUNK_OVERLAP)
    count = F.greatest(F.lit(1), F.ceil((n - vocab.CHUNK_OVERLAP) / F.lit(stride)))
    per_kind = (
        documents.select(item, "kind", n.alias("_n"), count.alias("_count"))
        .filter("_n > 0")
        .groupBy(item, "kind")
        .agg(F.count(F.lit(1)).alias("docs"), F.sum("_count").cast("long").alias("chunks"))
    )
    # One entry per kind: the vocabulary of kinds bounds the map.
    return per_kind.groupBy(item).agg(
        F.sum("docs").alias("total_docs"),
        F.sum("chunks").alias("total_chunks"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "docs")))).alias("by_kind"),
    )


def complete_snapshots(snapshots: DataFrame, documents: DataFrame, now: Column, item: str = "item_id") -> DataFrame:
    """Snapshots with the summary of their documents attached, marked complete at ``now``.

    A snapshot without a document has an empty summary. The parameters of its CSV files
    stay a table of their own: see ``snapshot_parameters``.
    """
    none = F.struct(
        F.lit(0).cast("long").alias("total_docs"),
        F.lit(0).cast("long").alias("total_chunks"),
        F.create_map().cast("map<string,bigint>").alias("by_kind"),
    )
    summary = document_statistics(documents, item).select(
        F.col(item).alias("_item"),
        F.struct(F.col("total_docs").cast("long").alias("total_docs"), F.col("total_chunks").cast("long").alias("total_chunks"), "by_kind").alias("_summary"),
    )
    kept = snapshots.drop("extracted_docs_summary", "ingestion_status", "ingestion_error", "completed_at")
    return kept.join(summary, F.col(item) == F.col("_item"), "left").select(
        *kept.columns,
        F.coalesce("_summary", none).alias("extracted_docs_summary"),
        F.lit("complete").alias("ingestion_status"),
        F.lit(None).cast("string").alias("ingestion_error"),
        now.alias("completed_at"),
    )


def snapshot_parameters(assets: DataFrame, parameters: DataFrame) -> DataFrame:
    """Parameter rows of every item's CSV files: item_id, file_id, row_index, parameter, value, source."""
    files = assets.filter("route = 'csv'").select("path", "item_id", "file_id")
    return files.join(parameters, "path").select("item_id", "file_id", "row_index", "parameter", "value", "source")


def ingest_documents(
    assets: DataFrame,
    csv_documents: DataFrame,
    mail_parts: DataFrame,
    extracted: DataFrame,
    items: DataFrame,
    *,
    max_mail_bytes: int | None = None,
    max_pdf_bytes: int | None = None,
    max_image_bytes: int | None = None,
    attachments_per_kind: int | None = None,
) -> DataFrame:
    """All text documents of an ingest run, one row per document.

    Everything is read unless the caller sets a limit; what a limit leaves unread has
    a document that says so.

    assets: file_id, item_id, path, filename, route, actual_size
    csv_documents: path, row_index, text
    mail_parts: path, part_kind, filename, text, size_bytes, part_index
    extracted: path, attachment (NULL for the asset itself), text
    items: item_id, column_values
    """
    columns = ["file_id", "item_id", "kind", "section", "page", "text"]
    no_page = F.lit(None).cast("int").alias("page")

    rows = assets.filter("route = 'csv'").join(csv_documents, "path")
    csv = rows.select(
        "file_id",
        "item_id",
        F.lit("csv").alias("kind"),
        F.concat(F.lit("row:"), F.col("row_index").cast("string")).alias("section"),
        no_page,
        "text",
    )

    mails = assets.filter("route = 'email'")
    over = exceeds_limit("actual_size", max_mail_bytes)
    large = mails.filter(over).select(
        "file_id",
        "item_id",
        F.lit("email").alias("kind"),
        F.lit("email:body").alias("section"),
        no_page,
        F.concat(F.lit("Email too large for extraction ("), F.col("actual_size").cast("string"), F.lit(" bytes).")).alias("text"),
    )
    mails = mails.filter(~over)
    parts = mails.select("file_id", "item_id", "path").join(mail_parts.withColumnRenamed("filename", "attachment"), "path")
    own = parts.filter(F.col("part_kind").isin("header", "body") & (text.strip("text") != "")).select(
        "file_id",
        "item_id",
        F.lit("email").alias("kind"),
        F.concat(F.lit("email:"), "part_kind").alias("section"),
        no_page,
        "text",
    )
    name = F.lower("attachment")
    group = (
        F.when(name.endswith(".pdf"), F.lit("pdf"))
        .when(name.rlike(r"\.(jpg|jpeg|png|webp)$"), F.lit("image"))
    )
    visual = parts.filter("part_kind = 'attachment'").withColumn("_group", group).filter("_group is not null")
    skipped = F.lit(False)
    if attachments_per_kind is not None:
        place = F.row_number().over(Window.partitionBy("path", "_group").orderBy("part_index"))
        visual = visual.withColumn("_place", place)
        skipped = F.col("_place") > attachments_per_kind
    too_large = ((F.col("_group") == "pdf") & exceeds_limit("size_bytes", max_pdf_bytes)) | (
        (F.col("_group") == "image") & exceeds_limit("size_bytes", max_image_bytes)
    )
    content = extracted.filter("attachment is not null").withColumnRenamed("text", "_extracted")
    label = F.concat(F.upper("_group"), F.lit(" ATTACHMENT ("), "attachment", F.lit(")"))
    attached = (
        visual.withColumn("_skipped", skipped)
        .join(content, ["path", "attachment"], "left")
        .select(
            "file_id",
            "item_id",
            F.col("_group").alias("kind"),
            F.concat(F.lit("email:attachment:"), "attachment").alias("section"),
            no_page,
            F.when(F.col("_skipped"), F.concat(label, F.lit(" [Not processed - attachment limit]")))
            .when(too_large, F.concat(label, F.lit(" [Too large for extraction]")))
            .otherwise(F.concat(label, F.lit(":\n"), F.coalesce("_extracted", F.lit(""))))
            .alias("text"),
        )
    )

    plain = assets.filter(F.col("route").isin("pdf", "image", "image_placeholder")).join(
        extracted.filter("attachment is null").select("path", F.col("text").alias("_extracted")), "path", "left"
    )
    files = plain.select(
        "file_id",
        "item_id",
        F.when(F.col("route") == "pdf", F.lit("pdf")).otherwise("image").alias("kind"),
        F.when(F.col("route") != "pdf", F.lit("image:description")).alias("section"),
        no_page,
        F.coalesce(placeholder_text("route", "filename", "actual_size", max_pdf_bytes, max_image_bytes), "_extracted").alias("text"),
    )

    described = items.select("item_id", column_text("column_values").alias("text")).filter("text <> ''")
    board = described.select(
        keys.derived_asset_id(F.concat(F.lit("columns:"), "item_id"), keys.digest("text"), F.lit(vocab.COLUMNS_FILENAME)).alias("file_id"),
        "item_id",
        F.lit(vocab.COLUMNS_KIND).alias("kind"),
        F.lit(vocab.COLUMNS_SECTION).alias("section"),
        no_page,
        "text",
    )
    out = csv.select(columns)
    for part in (own, large, attached, files, board):
        out = out.unionByName(part.select(columns))
    return out.filter("text is not null")


def derived_files(parts: DataFrame, parent: Column | str) -> DataFrame:
    """Attachment files of mails with their derived asset id and kind."""
    safe = text.safe_filename("filename")
    kind = F.when(F.col("part_kind") == "inline", F.lit("attachment_image")).otherwise(attachment_kind("filename"))
    return parts.filter(F.col("part_kind").isin("attachment", "inline")).select(
        "path", keys.derived_asset_id(parent, "sha256", safe).alias("asset_id"), kind.alias("kind"), "filename", "mime_type", "size_bytes", "sha256"
    )


def upsert(existing: DataFrame, incoming: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows after inserting or replacing by key; write the result to a new path.

    ``incoming`` holds one row per key.
    """
    return existing.join(incoming.select(*on), list(on), "left_anti").select(*existing.columns).unionByName(
        incoming.select(*existing.columns)
    )


def upsert_files(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """File rows by (task, snapshot, asset); a replaced row loses its deletion marks but keeps its id."""
    on = ["external_task_key", "snapshot_id", "asset_id"]
    old = existing.select(*on, F.col("id").alias("_id"))
    fresh = (
        incoming.join(old, on, "left")
        .withColumn("id", F.coalesce("_id", "id"))
        .withColumn("deleted_at", F.lit(None).cast(existing.schema["deleted_at"].dataType))
        .withColumn("delete_error", F.lit(None).cast("string"))
    )
    return upsert(existing, fresh, on)


def replace_by_file(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunk table after an ingest run: every re-read file is replaced as a whole."""
    seen = fresh.select("file_id").distinct()
    return chunks.join(seen, "file_id", "left_anti").unionByName(fresh.select(*chunks.columns))


def insert_missing(existing: DataFrame, incoming: DataFrame, on: Sequence[str]) -> DataFrame:
    """Insert distinct new keys, ignore the ones already there."""
    new = incoming.filter(" and ".join(f"{c} is not null" for c in on)).dropDuplicates(list(on))
    return existing.unionByName(new.join(existing.select(*on), list(on), "left_anti").select(*existing.columns))


def append_warnings(old: Column | str, new: Column | str) -> Column:
    """Warnings with the new ones appended, each once, order kept."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(text.col(old), empty), F.coalesce(text.col(new), empty)))


SEPARATOR = "=" * 50


def mail_pieces(parts: DataFrame) -> DataFrame:
    """The pieces of every mail's text in order: content, unprocessed names, PDFs by size, images, inline images.

    parts: item_id, asset_id, filename (of the mail), header, body, and per
    attachment row part_kind ('mail' | 'attachment' | 'inline'), attachment,
    size_bytes, part_index, text (extracted). Result: item_id, asset_id, filename,
    place (sortable within the mail), piece. One row per part, no shuffle; the text of a
    mail or item is the concatenation in order of (asset_id, place).
    """
    name = F.lower("attachment")
    image = name.rlike(r"\.(jpg|jpeg|png|gif|bmp)$")
    rank = (
        F.when(F.col("part_kind") == "mail", F.lit(0))
        .when(F.col("part_kind") == "inline", F.lit(4))
        .when(name.endswith(".pdf"), F.lit(2))
        .when(image, F.lit(3))
        .otherwise(1)
    )
    tail = F.concat(F.lit(" ("), F.col("attachment"), F.lit("):\n"), F.coalesce("text", F.lit("")), F.lit("\n\n"))
    piece = (
        F.when(rank == 0, F.concat(F.lit("EMAIL CONTENT:\n"), "header", F.lit("\n"), "body", F.lit("\n\n")))
        .when(rank == 1, F.concat(F.lit("\nATTACHMENT ("), "attachment", F.lit(") [Not processed - not a PDF or image]\n\n")))
        .when(rank == 2, F.concat(F.lit("\nPDF ATTACHMENT"), tail))
        .when(rank == 3, F.concat(F.lit("\nIMAGE ATTACHMENT"), tail))
        .otherwise(F.concat(F.lit("\nINLINE IMAGE"), tail))
    )
    size = F.when(rank == 2, F.col("size_bytes")).otherwise(F.lit(0)).cast("long")
    place = F.struct(rank.alias("rank"), size.alias("size"), F.col("part_index").alias("part"))
    return parts.select("item_id", "asset_id", "filename", place.alias("place"), piece.alias("piece"))


def mail_texts(parts: DataFrame) -> DataFrame:
    """One text per mail, for callers that need it as one value: it must fit into a Spark string."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "piece")))
    joined = mail_pieces(parts).groupBy("item_id", "asset_id", "filename").agg(ordered.alias("_ps"))
    return joined.select(
        "item_id", "asset_id", "filename", F.array_join(F.transform("_ps", lambda p: p["piece"]), "").alias("mail_text")
    )


def item_texts(mails: DataFrame) -> DataFrame:
    """All mails of an item in numeric asset order, with the hash of the text.

    For callers that need one value, as the revision hash does; ``mail_pieces`` is the
    form for items of any size.
    """
    block = F.concat(
        F.lit("\n\nEMAIL FILE: "), "filename", F.lit("\n"), "mail_text", F.lit(f"\n{SEPARATOR}\n")
    )
    order = F.struct(F.col("asset_id").cast("decimal(38,0)").alias("n"), F.col("filename").alias("f"), block.alias("t"))
    grouped = mails.groupBy("item_id").agg(F.array_sort(F.collect_list(order)).alias("_m"))
    whole = F.array_join(F.transform("_m", lambda m: m["t"]), "")
    return grouped.select("item_id", whole.alias("all_text")).withColumn("text_sha256", keys.digest("all_text"))


def split_batched_pdf_text(c: Column | str) -> Column:
    """``array<struct<filename,text>>`` of a text with ``=== PDF: name ===`` lines; a later name wins."""
    unix = F.regexp_replace(text.col(c), r"\r\n?", "\n")
    sections = F.filter(F.split(F.concat(F.lit("\n"), unix), r"\n=== PDF:"), lambda s, i: i > 0)
    pairs = F.transform(
        sections,
        lambda s: F.struct(
            text.strip(F.replace(F.regexp_extract(s, r"^([^\n]*)", 1), F.lit("==="), F.lit(""))).alias("filename"),
            text.strip(F.regexp_replace(s, r"^[^\n]*\n?", "")).alias("text"),
        ),
    )
    names = F.transform(pairs, lambda p: p["filename"])
    return F.filter(
        pairs, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p["filename"])
    )
