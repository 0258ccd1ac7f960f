"""Keys, paths and content revisions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from worklens.functions.text import col


def joined(*parts: Column | str | None, sep: str = ":") -> Column:
    """Concatenation that is NULL when a part is NULL (unlike ``concat_ws``)."""
    out: list[Column] = []
    for part in parts:
        if out:
            out.append(F.lit(sep))
        out.append(col(part).cast("string"))
    return F.concat(*out)


def task_key(account: Column | str, board: Column | str, item: Column | str) -> Column:
    return joined(account, board, item)


def is_task_key(c: Column | str) -> Column:
    return col(c).rlike(r"^[^:]+:[^:]+:[^:]+\z")


def object_path(
    root: Column | str, account: Column | str, board: Column | str, item: Column | str, version: Column | str, asset: Column | str, filename: Column | str
) -> Column:
    """Storage path of one asset of a snapshot; ``root`` is the source system's folder."""
    head = F.lit(root) if isinstance(root, str) else root
    return joined(head, account, board, item, version, asset, filename, sep="/")


def derived_asset_id(parent: Column | str, sha256: Column | str, safe_name: Column | str) -> Column:
    return joined(F.lit("derived"), parent, F.substring(col(sha256), 1, 12), safe_name)


def digest(c: Column | str) -> Column:
    return F.sha2(col(c).cast("string").cast("binary"), 256)


def artifact_object_key(
    board: Column | str, item: Column | str, input_revision: Column | str, version: Column | str, filename: Column | str
) -> Column:
    return joined(F.lit("design-processing"), board, item, input_revision, digest(version), filename, sep="/")


def artifact_filenames(item: Column | str, input_revision: Column | str, version: Column | str) -> Column:
    """``struct<ai_data,ai_data_pdf,match_report>`` of file names fixed by the identity."""
    label = joined(item, F.substring(col(input_revision), 1, 12), F.substring(digest(version), 1, 12), sep="_")
    return F.struct(
        F.concat(F.lit("AI_Data_"), label, F.lit(".csv")).alias("ai_data"),
        F.concat(F.lit("AI_Data_Preview_"), label, F.lit(".pdf")).alias("ai_data_pdf"),
        F.concat(F.lit("Matched_Projects_"), label, F.lit(".pdf")).alias("match_report"),
    )


def processing_version(
    manifest_digest: Column | str, model: Column | str, thinking: Column | str, revision: Column | str
) -> Column:
    return F.concat(
        F.lit("legacy-files-"),
        col(manifest_digest),
        F.lit(":model-"),
        col(model),
        F.lit(":thinking-"),
        col(thinking),
        F.lit(":"),
        col(revision),
    )


def distinct_ids(*arrays: Column) -> Column:
    """Text-sorted distinct ids of several id arrays; NULL arrays and ids are ignored."""
    empty = F.array().cast("array<string>")
    merged = F.flatten(F.array(*[F.coalesce(a.cast("array<string>"), empty) for a in arrays]))
    return F.array_sort(F.array_distinct(F.array_compact(merged)))


def snapshot_version(updated_at: Column | str, asset_ids: Column | str) -> Column:
    """Content hash of an item: last update plus its sorted asset ids."""
    return digest(F.concat(F.coalesce(col(updated_at), F.lit("")), F.lit(":"), F.array_join(col(asset_ids), ",")))


def numeric_then_name(assets: Column | str) -> Column:
    """Sort ``array<struct<asset_id,created_at,filename,size>>`` by numeric id, then name."""
    keyed = F.transform(
        col(assets),
        lambda a: F.struct(
            a["asset_id"].cast("decimal(38,0)").alias("n"),
            a["filename"].alias("f"),
            a["created_at"].alias("c"),
            a["size"].cast("long").alias("s"),
            a["asset_id"].alias("a"),
        ),
    )
    return F.transform(
        F.array_sort(keyed),
        lambda k: F.struct(
            k["a"].alias("assetId"), k["c"].alias("createdAt"), k["f"].alias("filename"), k["s"].alias("size")
        ),
    )


def input_revision(assets: Column | str) -> Column:
    """Hash of the ordered asset records as compact JSON; NULL without assets."""
    ordered = numeric_then_name(assets)
    return F.when(F.size(col(assets)) > 0, digest(F.to_json(ordered)))


def positive_decimal_id(c: Column | str) -> Column:
    """Decimal id without leading zeros, or NULL when it is not a positive number."""
    text = F.regexp_replace(F.trim(col(c).cast("string")), "^0+", "")
    return F.when(text.rlike("^[0-9]+$"), text)
