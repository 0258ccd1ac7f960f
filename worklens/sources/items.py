"""Exported item documents: scan, identity, revision inputs, assets and columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from worklens import schemas, vocab
from worklens.functions import keys
from worklens.functions.text import col, strip


def read_items(spark: SparkSession, path: str, account_id: Column | str | None = None) -> DataFrame:
    """Typed item documents (one JSON object per line or file)."""
    items = spark.read.schema(schemas.ITEM).option("mode", "PERMISSIVE").json(path)
    return with_account(items, account_id)


def stream_items(spark: SparkSession, path: str, account_id: Column | str | None = None) -> DataFrame:
    """The same documents as a stream over the export directory."""
    return with_account(spark.readStream.schema(schemas.ITEM).json(path), account_id)


def with_account(items: DataFrame, account_id: Column | str | None) -> DataFrame:
    """Attach the account known from outside the document."""
    if account_id is None:
        return items
    outside = F.lit(account_id) if isinstance(account_id, str) else account_id
    return items.withColumn("account_id", F.coalesce(F.nullif("account_id", F.lit("")), outside))


def _first_text(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns])


def resolve_identity(items: DataFrame, fallback_account: str | None = None) -> DataFrame:
    """Account, board, item, group and task key of every document, with typed errors."""
    account = _first_text(
        F.col("account.id"), F.col("board.account.id"), F.col("account_id"), F.lit(fallback_account).cast("string")
    )
    board = _first_text(F.col("board.id"), F.col("board_id"))
    item = _first_text(F.col("id"), F.col("item_id"))
    errors = F.array_compact(
        F.array(
            F.when(account.isNull(), F.lit("account_missing")),
            F.when(board.isNull(), F.lit("board_missing")),
            F.when(item.isNull(), F.lit("item_missing")),
        )
    )
    return items.select(
        account.alias("account_id"),
        board.alias("board_id"),
        item.alias("item_id"),
        _first_text(F.col("group.id"), F.col("group_id")).alias("group_id"),
        _first_text(F.col("group.title"), F.col("group_title")).alias("group_title"),
        keys.task_key(account, board, item).alias("external_task_key"),
        source_revision().alias("source_revision"),
        errors.alias("errors"),
    )


def source_revision() -> Column:
    """Snapshot version of an item document: last update and distinct asset ids."""
    own = F.transform(F.col("assets"), lambda a: a["id"])
    updates = F.flatten(
        F.transform(F.col("updates"), lambda u: F.transform(F.coalesce(u["assets"], F.array().cast(schemas.ITEM["assets"].dataType)), lambda a: a["id"]))
    )
    return keys.snapshot_version("updated_at", keys.distinct_ids(own, updates))


def select_from_groups(
    items: DataFrame,
    group_ids: Sequence[str],
    limit: int | None,
    group: str = "group_id",
    position: str = "source_pos",
) -> DataFrame:
    """Items of the groups, groups in id order and items in source order, up to a limit."""
    chosen = items.filter(F.col(group).isin(*group_ids))
    return chosen if limit is None else chosen.orderBy(group, position).limit(limit)


def kind_from_title(title: Column | str) -> Column:
    text = F.lower(strip(F.coalesce(col(title), F.lit(""))))
    slug = F.btrim(F.regexp_replace(text, "[^a-z0-9]+", "_"), F.lit("_"))
    return (
        F.when(text == "email", F.lit("email"))
        .when(text.isin("ai data", "ai_data"), F.lit("csv"))
        .otherwise(F.coalesce(F.nullif(slug, F.lit("")), F.lit("attachment")))
    )


def _column_files() -> Column:
    """``array<struct<asset_id,kind>>`` of the file columns, the deciding (last) entry first."""
    per_column = F.transform(
        F.filter("column_values", lambda c: c["type"] == "file"),
        lambda c: F.transform(
            F.coalesce(F.from_json(c["value"], schemas.FILE_COLUMN)["files"], F.array().cast(schemas.FILE_COLUMN["files"].dataType)),
            lambda f: F.struct(f["assetId"].alias("asset_id"), kind_from_title(c["column"]["title"]).alias("kind")),
        ),
    )
    return F.reverse(F.filter(F.flatten(per_column), lambda f: f["asset_id"].isNotNull()))


def asset_kinds(items: DataFrame, item: str = "item_id") -> DataFrame:
    """Kind of every asset named by a file column; a later column wins. Bad JSON is skipped.

    Everything is in one document, so the rows are decided without a shuffle.
    """
    files = items.select(item, _column_files().alias("_f"))
    ids = files.withColumn("_ids", F.transform("_f", lambda f: f["asset_id"]))
    first = F.filter("_f", lambda f, i: F.array_position("_ids", f["asset_id"]) == i + 1)
    return ids.select(item, F.inline(first))


def asset_jobs(items: DataFrame, item: str = "item_id") -> DataFrame:
    """Assets to ingest: item assets first, then update assets; first occurrence wins.

    Decided inside each document, without a shuffle.
    """
    none = F.array().cast(schemas.ITEM["assets"].dataType)
    own = F.coalesce("assets", none)
    later = F.coalesce(F.flatten(F.transform("updates", lambda u: F.coalesce(u["assets"], none))), none)
    staged = items.select(
        item,
        F.filter(F.concat(own, later), lambda a: F.length(a["id"]) > 0).alias("_assets"),
        F.size(F.filter(own, lambda a: F.length(a["id"]) > 0)).alias("_own"),
        _column_files().alias("_f"),
    )
    staged = staged.withColumn("_ids", F.transform("_assets", lambda a: a["id"])).withColumn(
        "_named", F.transform("_f", lambda f: f["asset_id"])
    )

    def job(asset: Column, i: Column) -> Column:
        named = F.get(F.col("_f"), (F.array_position("_named", asset["id"]) - 1).cast("int"))["kind"]
        kind = F.when(i >= F.col("_own"), F.lit("update_attachment")).otherwise(F.coalesce(named, F.lit("attachment")))
        return F.struct(
            asset["id"].alias("asset_id"),
            kind.alias("kind"),
            i.alias("pos"),
            (F.array_position("_ids", asset["id"]) == i + 1).alias("first"),
            asset.alias("asset"),
        )

    jobs = F.filter(F.transform("_assets", job), lambda j: j["first"])
    return staged.select(item, F.inline(jobs)).drop("first")


def column_text(columns: Column | str = "column_values") -> Column:
    """Lines ``Column: t | Value: v`` of the allowed titles, in document order."""
    value = lambda c: F.coalesce(*[F.nullif(c[f], F.lit("")) for f in ("display_value", "text", "value")])
    kept = F.filter(
        col(columns), lambda c: c["column"]["title"].isin(*vocab.COLUMN_TEXT_TITLES) & value(c).isNotNull()
    )
    lines = F.transform(
        kept, lambda c: F.concat(F.lit("Column: "), c["column"]["title"], F.lit(" | Value: "), value(c))
    )
    return F.array_join(lines, "\n")


def project_label(items: DataFrame, files: DataFrame, item: str = "item_id") -> DataFrame:
    """Project of an item: first filled project column, else the number in a file name.

    files: item, original_filename, file_pos.
    """
    from worklens.functions.values import project_number

    titles = [t.lower() for t in vocab.PROJECT_TITLES]
    value = lambda c: strip(F.coalesce(*[F.nullif(c[f], F.lit("")) for f in ("display_value", "text", "value")]))
    hits = F.filter(
        F.transform(
            F.col("column_values"),
            lambda c: F.struct(F.lower(strip(c["column"]["title"])).alias("t"), value(c).alias("v")),
        ),
        lambda x: x["t"].isin(*titles) & (F.length(x["v"]) > 0),
    )
    named = files.withColumn("_number", project_number("original_filename")).filter("_number is not null")
    by_file = named.groupBy(item).agg(F.min_by("_number", "file_pos").alias("_number"))
    columns = items.select(item, F.try_element_at(hits, F.lit(1))["v"].alias("_column"))
    return columns.join(by_file, item, "left").select(item, F.coalesce("_column", "_number", F.lit("")).alias("project"))


def active_projects(items: DataFrame, start_date: str, title_column: str, created_column: str) -> DataFrame:
    """Project rows of an export: active and created on or after the start date."""
    import datetime as dt

    if dt.date.fromisoformat(start_date).isoformat() != start_date:
        raise ValueError("start_date must use YYYY-MM-DD format")

    def text_of(column_id: str) -> Column:
        found = F.filter(
            F.col("column_values"), lambda c: (c["id"] == column_id) & (F.length(F.coalesce(c["text"], F.lit(""))) > 0)
        )
        return F.try_element_at(found, F.lit(-1))["text"]

    rows = items.select(
        keys.positive_decimal_id("id").alias("item_id"),
        F.col("name").alias("project_reference"),
        F.coalesce(text_of(title_column), "name").alias("project_title"),
        "state",
        text_of(created_column).alias("created_date"),
    )
    return since(rows, start_date)


def since(projects: DataFrame, start_date: str) -> DataFrame:
    """Active project rows on or after the start date; the title falls back to the reference."""
    return projects.filter((F.col("created_date") >= start_date) & (F.col("state") == "active")).withColumn(
        "project_title", F.coalesce(F.nullif("project_title", F.lit("")), "project_reference")
    )


