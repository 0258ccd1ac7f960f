"""Group policy, mode gates and readiness: small CASE rules over literals."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from worklens import vocab
from worklens.functions.text import col


@dataclass(frozen=True)
class Policy:
    """Settings of the managed board; the group lists are configuration, a few ids each."""

    board_id: str
    active_group_ids: tuple[str, ...]
    excluded_group_ids: tuple[str, ...]
    completed_group_id: str
    enabled: bool = True
    retention_days: int = vocab.RETENTION_DAYS
    debounce_seconds: int = vocab.DEBOUNCE_SECONDS
    backfill_batch_size: int = 10

    def purge_after(self, base: Column) -> Column:
        return base + F.make_dt_interval(days=F.lit(self.retention_days))


def _decision(state: str | None, track: bool, queue: bool, cancel: bool, indexed: bool, reason: str) -> Column:
    return F.struct(
        F.lit(state).cast("string").alias("lifecycle_state"),
        F.lit(track).alias("should_track"),
        F.lit(queue).alias("should_queue"),
        F.lit(cancel).alias("should_cancel"),
        F.lit(indexed).alias("requires_index"),
        F.lit(reason).alias("reason"),
    )


def classify(policy: Policy, board: Column | str, group: Column | str) -> Column:
    """Decision struct for an item in this board and group."""
    group = col(group).cast("string")
    active_reason = "active_group" if policy.enabled else "auto_sync_disabled"
    return (
        F.when(
            ~col(board).cast("string").eqNullSafe(F.lit(policy.board_id)),
            _decision(None, False, False, False, False, "board_not_managed"),
        )
        .when(
            group.isin(*policy.excluded_group_ids), _decision("excluded", True, False, True, False, "excluded_group")
        )
        .when(
            group.isin(*policy.active_group_ids),
            _decision("active", True, policy.enabled, False, False, active_reason),
        )
        .when(
            group == policy.completed_group_id,
            _decision("completed_retained", True, False, False, True, "completed_retention_only"),
        )
        .otherwise(_decision(None, False, False, False, False, "unknown_group"))
    )


def with_allowlist(df: DataFrame, allowlist: DataFrame | Iterable[str] | None, item: str = "item_id") -> DataFrame:
    """Adds ``listed``; a table is joined (Spark broadcasts it only when it is small)."""
    if isinstance(allowlist, DataFrame):
        ids = allowlist.select(F.col(allowlist.columns[0]).cast("string").alias(item)).distinct()
        return df.join(ids.withColumn("listed", F.lit(True)), item, "left").withColumn(
            "listed", F.coalesce("listed", F.lit(False))
        )
    values = [str(v) for v in allowlist or ()]
    listed = F.col(item).cast("string").isin(*values) if values else F.lit(False)
    return df.withColumn("listed", listed)


def publication_allowed(mode: Column | str, listed: Column | str) -> Column:
    mode = F.lit(mode) if isinstance(mode, str) else mode
    return F.when(mode == "enabled", True).when(mode == "allowlist", col(listed)).otherwise(False)


def execution_allowed(mode: Column | str, kind: Column | str, listed: Column | str) -> Column:
    """Analysis runs unless the mode is off; publication needs the mode or the list."""
    mode_col = F.lit(mode) if isinstance(mode, str) else mode
    return F.when(col(kind) == "publication", publication_allowed(mode, listed)).otherwise(mode_col != "off")


def target_readiness(board_id: str, group_id: str, board: str = "board_id", group: str = "group_id", state: str = "item_state", missing_name: Column | str = "missing_name", missing_email: Column | str = "missing_email") -> Column:
    elsewhere = ~F.col(board).eqNullSafe(F.lit(board_id)) | ~F.col(group).eqNullSafe(F.lit(group_id))
    return (
        F.when(~F.col(state).eqNullSafe(F.lit("active")) | elsewhere, F.lit("ineligible"))
        .when(col(missing_name), F.lit("waiting_for_name"))
        .when(col(missing_email), F.lit("waiting_for_email"))
        .otherwise("ready")
    )


def identity(revision: Column | str, version: Column | str) -> Column:
    """Nullable pair; a half-filled pair is treated as an error by the integrity job."""
    pair = F.struct(col(revision).alias("input_revision"), col(version).alias("pipeline_version"))
    return F.when(col(revision).isNotNull() & col(version).isNotNull(), pair)


def same(a: Column | str, b: Column | str) -> Column:
    return col(a).eqNullSafe(col(b))


def needs_analysis(desired: Column | str, analyzed: Column | str) -> Column:
    return col(desired).isNotNull() & ~same(desired, analyzed)


def next_obligation(desired: Column | str, analyzed: Column | str, published: Column | str, allowed: Column | str) -> Column:
    """``analysis``, ``publication`` or NULL from the three identities as wholes."""
    publish = col(allowed) & col(desired).isNotNull() & same(desired, analyzed) & ~same(desired, published)
    return F.when(needs_analysis(desired, analyzed), F.lit("analysis")).when(publish, F.lit("publication"))
