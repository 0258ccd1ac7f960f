"""Contracts and integrity rules as data-quality jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from worklens import schemas, vocab
from worklens.functions import keys
from worklens.functions.dates import normalize_utc
from worklens.functions.text import strip
from worklens.operators.routing import file_suffix, is_supported_email
from worklens.functions.values import lenient_size


def intake_contract(items: DataFrame) -> DataFrame:
    """Validated intake target of every item document, with typed errors.

    The membership of the mail column is checked against the asset records of
    the same document, so no join and no shuffle is needed. Valid rows carry the
    ordered mail assets and their revision.
    """
    nothing = F.array().cast(schemas.FILE_COLUMN["files"].dataType)
    mail_columns = F.filter("column_values", lambda c: c["id"] == vocab.EMAIL_COLUMN)
    staged = items.select("*", mail_columns.alias("_mail")).withColumn(
        "_raw", F.try_element_at("_mail", F.lit(1))["value"]
    )
    empty = F.coalesce(F.col("_raw"), F.lit("")) == ""
    staged = staged.withColumn("_files", F.when(empty, nothing).otherwise(F.from_json("_raw", schemas.FILE_COLUMN)["files"]))

    meta = F.transform("assets", lambda a: F.struct(keys.positive_decimal_id(a["id"]).alias("n"), a.alias("a")))
    staged = staged.withColumn("_meta", meta)
    resolved = F.transform(
        "_files",
        lambda f: F.struct(
            keys.positive_decimal_id(f["assetId"]).alias("asset_id"),
            f["name"].alias("member_name"),
            F.try_element_at(
                F.filter("_meta", lambda m: m["n"] == keys.positive_decimal_id(f["assetId"])), F.lit(1)
            )["a"].alias("a"),
        ),
    )
    staged = staged.withColumn("_members", resolved)

    def dropped(m: Column) -> Column:
        """Members that are no mails: by record, or by name when the record is missing."""
        by_name = m["a"].isNull() & (file_suffix(m["member_name"]) != "") & ~is_supported_email(m["member_name"], F.lit(None).cast("string"))
        return by_name | (m["a"].isNotNull() & ~is_supported_email(m["a"]["name"], m["a"]["file_extension"]))

    mails = F.filter("_members", lambda m: ~dropped(m))
    staged = staged.withColumn("_mails", mails)

    def problem(m: Column) -> Column:
        a = m["a"]
        return (
            F.when(m["asset_id"].isNull(), F.lit("member_id_invalid"))
            .when(a.isNull(), F.lit("asset_metadata_missing"))
            .when(F.coalesce(a["name"], F.lit("")) == "", F.lit("filename_missing"))
            .when(~F.coalesce(F.trim(a["file_size"]).rlike("^[0-9]+$"), F.lit(False)), F.lit("size_invalid"))
            .when(normalize_utc(a["created_at"]).isNull(), F.lit("created_at_invalid"))
            .when(
                F.coalesce(F.nullif(a["public_url"], F.lit("")), F.nullif(a["url"], F.lit(""))).isNull(),
                F.lit("url_missing"),
            )
        )

    ids = F.transform("_mails", lambda m: m["asset_id"])
    meta_ids = F.transform("_meta", lambda m: m["n"])
    row_errors = F.array_compact(
        F.array(
            F.when(F.coalesce(strip("board.id"), F.lit("")) == "", F.lit("board_missing")),
            F.when(F.coalesce(strip("group.id"), F.lit("")) == "", F.lit("group_missing")),
            F.when(keys.positive_decimal_id("id").isNull(), F.lit("item_id_invalid")),
            F.when(F.coalesce(strip("state"), F.lit("")) == "", F.lit("state_missing")),
            F.when(F.coalesce(F.size("_mail"), F.lit(0)) != 1, F.lit("email_column_not_unique")),
            F.when(F.col("_files").isNull() & ~empty, F.lit("email_value_malformed")),
            F.when(F.col("assets").isNull(), F.lit("assets_missing")),
            F.when(F.exists("_meta", lambda m: m["n"].isNull()), F.lit("asset_id_invalid")),
            F.when(F.size("_meta") != F.size(F.array_distinct(meta_ids)), F.lit("asset_id_duplicate")),
            F.when(F.size("_mails") != F.size(F.array_distinct(ids)), F.lit("member_id_duplicate")),
        )
    )
    errors = F.concat(row_errors, F.coalesce(F.array_compact(F.transform("_mails", problem)), F.array().cast("array<string>")))
    records = F.transform(
        "_mails",
        lambda m: F.struct(
            m["asset_id"].alias("asset_id"),
            normalize_utc(m["a"]["created_at"]).alias("created_at"),
            m["a"]["name"].alias("filename"),
            lenient_size(m["a"]["file_size"]).alias("size"),
        ),
    )
    staged = staged.withColumn("errors", errors).withColumn("_records", records)
    fine = F.size("errors") == 0
    return staged.select(
        keys.positive_decimal_id("id").alias("item_id"),
        strip("board.id").alias("board_id"),
        strip("group.id").alias("group_id"),
        F.col("state").alias("item_state"),
        F.coalesce("name", F.lit("")).alias("name"),
        (strip(F.coalesce("name", F.lit(""))) == "").alias("missing_name"),
        F.when(fine, F.size("_records") == 0).alias("missing_email"),
        F.when(fine, F.col("_records")).alias("email_assets"),
        F.when(fine, keys.input_revision("_records")).alias("input_revision"),
        "errors",
    )


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and rejects of a frame with an ``errors`` array."""
    bad = F.size("errors") > 0
    return checked.filter(~bad).drop("errors"), checked.filter(bad)


def membership_join(members: DataFrame, assets: DataFrame) -> DataFrame:
    """Column members with their asset record; what to do with each.

    members: item_id, asset_id, member_name. assets: item_id, asset_id, name,
    file_extension. Duplicates are found by a count, so a hot item is combined
    on the map side.
    """
    pair = ["item_id", "asset_id"]
    counts = members.groupBy(*pair).agg(F.count(F.lit(1)).alias("_n"))
    records = assets.select(*pair, "name", "file_extension", F.lit(True).alias("_known"))
    df = members.join(counts, pair).join(records, pair, "left")
    nothing = F.lit(None).cast("string")
    verdict = (
        F.when(
            F.col("_known").isNull()
            & (file_suffix("member_name") != "")
            & ~is_supported_email("member_name", nothing),
            F.lit("dropped"),
        )
        .when(F.col("_known").isNull(), F.lit("metadata_missing"))
        .when(~is_supported_email("name", "file_extension"), F.lit("dropped"))
        .when(F.col("_n") > 1, F.lit("duplicate"))
        .otherwise("kept")
    )
    return df.select(*pair, "member_name", "name", verdict.alias("verdict"))


def duplicates(df: DataFrame, on: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _row_rules(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """(rule, key, n) of every broken row rule, in one pass."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(~ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(key.cast("string").alias("key"), F.explode(broken).alias("rule")).select("rule", "key", F.lit(1).cast("long").alias("n"))


def _unique(df: DataFrame, rule: str, on: list[str], where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.filter(where)
    found = duplicates(rows, on)
    return found.select(F.lit(rule).alias("rule"), F.concat_ws(":", *[F.col(c).cast("string") for c in on]).alias("key"), "n")


def paired(revision: Column, version: Column) -> Column:
    return revision.isNull() == version.isNull()


def integrity_violations(
    *,
    items: DataFrame | None = None,
    design_jobs: DataFrame | None = None,
    sync_jobs: DataFrame | None = None,
    artifacts: DataFrame | None = None,
    dispatches: DataFrame | None = None,
    snapshots: DataFrame | None = None,
) -> DataFrame:
    """All broken rules of the given tables as (rule, key, n); empty when clean."""
    found: list[DataFrame] = []
    if items is not None:
        rules = {"item_state": F.col("state").isin(*vocab.DESIGN_ITEM_STATES)}
        for pair in ("desired", "analyzed", "published"):
            rules[f"item_{pair}_identity"] = paired(F.col(f"{pair}_input_revision"), F.col(f"{pair}_pipeline_version"))
        found.append(_row_rules(items, F.concat_ws(":", "board_id", "item_id"), rules))
        found.append(_unique(items, "item_unique", ["board_id", "item_id"]))
    if design_jobs is not None:
        rules = {
            "job_status": F.col("status").isin(*vocab.DESIGN_JOB_STATUSES),
            "job_stage": F.col("stage").isNull() | F.col("stage").isin(*vocab.DESIGN_STAGES),
            "job_kind": F.col("execution_kind").isNull() | F.col("execution_kind").isin(*vocab.EXECUTION_KINDS),
            "job_counters": (F.col("attempt_count") >= 0) & (F.col("max_attempts") > 0),
        }
        found.append(_row_rules(design_jobs, F.col("id"), rules))
        active = F.col("status").isin(*vocab.ACTIVE_DESIGN_JOB_STATUSES)
        found.append(_unique(design_jobs, "one_active_job", ["board_id", "item_id"], active))
    if sync_jobs is not None:
        found.append(_row_rules(sync_jobs, F.col("id"), {"sync_job_status": F.col("status").isin(*vocab.SYNC_JOB_STATUSES)}))
        active = F.col("status").isin(*vocab.ACTIVE_SYNC_JOB_STATUSES)
        found.append(_unique(sync_jobs, "one_active_sync_job", ["board_id", "item_id"], active))
    if artifacts is not None:
        rules = {
            "artifact_kind": F.col("artifact_kind").isin(*vocab.ARTIFACT_KINDS),
            "artifact_status": F.col("status").isin(*vocab.ARTIFACT_STATUSES),
            "artifact_size": F.col("size_bytes") >= 0,
        }
        found.append(_row_rules(artifacts, F.col("id"), rules))
        identity = ["board_id", "item_id", "column_id", "artifact_kind", "input_revision", "pipeline_version"]
        found.append(_unique(artifacts, "artifact_unique", identity))
    if dispatches is not None:
        rules = {
            "dispatch_consumer": F.col("consumer").isin(*vocab.DISPATCH_CONSUMERS),
            "dispatch_status": F.col("status").isin(*vocab.DISPATCH_STATUSES),
            "dispatch_outcome": F.col("outcome").isNull() | F.col("outcome").isin(*vocab.DISPATCH_OUTCOMES),
        }
        found.append(_row_rules(dispatches, F.concat_ws(":", "event_id", "consumer"), rules))
        found.append(_unique(dispatches, "one_dispatch_per_consumer", ["event_id", "consumer"]))
    if snapshots is not None:
        found.append(_unique(snapshots, "snapshot_unique", ["external_task_key", "snapshot_version"]))
    return reduce(DataFrame.unionByName, found)


def fingerprint_audit(stored: DataFrame, scanned: DataFrame, on: str = "path") -> DataFrame:
    """Recorded against actual bytes: missing objects, wrong hash, wrong size.

    stored: path, sha256, size_bytes. scanned: path, sha256, size_bytes (of the binary scan).
    """
    actual = scanned.select(on, F.col("sha256").alias("_sha"), F.col("size_bytes").alias("_size"))
    verdict = (
        F.when(F.col("_sha").isNull(), F.lit("missing"))
        .when(F.col("_sha") != F.col("sha256"), F.lit("hash_mismatch"))
        .when(F.col("_size") != F.col("size_bytes"), F.lit("size_mismatch"))
        .otherwise("ok")
    )
    return stored.join(actual, on, "left").withColumn("verdict", verdict).drop("_sha", "_size")


def metadata_conflicts(artifacts: DataFrame, rendered: DataFrame) -> DataFrame:
    """Stored artifacts whose metadata differs from a new rendering of the same identity."""
    identity = ["board_id", "item_id", "column_id", "artifact_kind", "input_revision", "pipeline_version"]
    compared = ["deterministic_filename", "content_sha256", "size_bytes"]
    new = rendered.select(*identity, *[F.col(c).alias(f"_new_{c}") for c in compared])
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_new_{c}")) for c in compared])
    kept = artifacts.filter(F.col("status").isin("rendered", "published"))
    return kept.join(new, identity).filter(differs).select("id", *identity)
