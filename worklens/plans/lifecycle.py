"""Plan tables of the task life cycle: backfill, reconciliation, retention, purge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from worklens import vocab
from worklens.plans.policy import Policy, classify
from worklens.plans.design import PAIR, pick_active_job
from worklens.scale import keep_first

KEY = "external_task_key"


def latest_complete(snapshots: DataFrame, key: str = KEY) -> DataFrame:
    """Newest complete snapshot per task; building and failed ones are ignored."""
    complete = snapshots.filter(F.col("ingestion_status") == "complete")
    return keep_first(complete, [key], [F.col("created_at").desc(), F.col("id").desc()])


def _active_flag(jobs: DataFrame) -> DataFrame:
    active = jobs.filter(F.col("status").isin(*vocab.ACTIVE_SYNC_JOB_STATUSES))
    return active.select(*PAIR).distinct().withColumn("_active", F.lit(True))


def indexed_at(revision: Column | str) -> Column:
    """Does the revision equal the indexed or the snapshot revision of the task?"""
    wanted = F.col(revision) if isinstance(revision, str) else revision
    return F.coalesce(wanted == F.col("last_indexed_source_revision"), F.lit(False)) | F.coalesce(
        wanted == F.col("latest_snapshot_version"), F.lit(False)
    )


def backfill_plan(items: DataFrame, tasks: DataFrame, policy: Policy) -> DataFrame:
    """What a backfill would do with every selected item.

    items: identity columns and ``source_revision``.
    """
    stored = tasks.select(KEY, F.col("last_indexed_source_revision").alias("_indexed"))
    df = items.join(stored, KEY, "left").withColumn("_d", classify(policy, "board_id", "group_id"))
    action = (
        F.when(~F.col("_d.should_track"), F.lit("ignored"))
        .when(~F.col("_d.should_queue"), F.lit("skipped"))
        .when(F.col("_indexed") == F.col("source_revision"), F.lit("fresh"))
        .otherwise("would_queue")
    )
    return df.select("item_id", "group_id", KEY, action.alias("action"), F.col("_d.reason").alias("reason"), "source_revision")


def reconciliation_plan(
    items: DataFrame,
    tasks: DataFrame,
    jobs: DataFrame,
    policy: Policy,
    *,
    now: Column,
    stuck_after_seconds: int = vocab.LEASE_SECONDS,
) -> DataFrame:
    """Reason, queue decision and job revision for every current active item."""
    stored = tasks.select(
        KEY,
        "auto_sync_state",
        "sync_status",
        "sync_started_at",
        "sync_requested_at",
        "last_indexed_source_revision",
        "latest_snapshot_version",
        F.lit(True).alias("_stored"),
    )
    df = items.join(stored, KEY, "left").join(_active_flag(jobs), PAIR, "left")
    df = df.withColumn("_d", classify(policy, "board_id", "group_id"))
    active = F.coalesce(F.col("_active"), F.lit(False))
    status = F.coalesce("sync_status", F.lit(""))
    since = F.when(status == "syncing", F.col("sync_started_at")).otherwise(F.col("sync_requested_at"))
    overdue = since.isNull() | (since <= now - F.make_dt_interval(secs=F.lit(stuck_after_seconds)))
    stuck = status.isin("queued", "syncing") & (~active | overdue)
    indexed = indexed_at("source_revision")
    reason = (
        F.when(F.col("_stored").isNull(), F.lit("missing"))
        .when(F.col("auto_sync_state") == "expired", F.lit("restore"))
        .when(status == "failed", F.lit("failed"))
        .when(stuck, F.lit("stuck"))
        .when(status.isin("queued", "syncing"), F.lit("already_queued"))
        .when(~indexed | (status != "completed"), F.lit("stale"))
        .otherwise("fresh")
    )
    df = df.withColumn("sync_reason", reason)
    queue = F.col("_d.should_queue") & F.col("sync_reason").isin("missing", "restore", "failed", "stuck", "stale")
    revision = F.when(~(F.col("sync_reason").isin("failed", "stuck") & indexed), F.col("source_revision"))
    return df.select(
        "item_id",
        "group_id",
        KEY,
        "sync_reason",
        queue.alias("queue"),
        F.when(queue, F.concat(F.lit("would_queue_"), "sync_reason")).otherwise(F.col("sync_reason")).alias("action"),
        F.col("_d.reason").alias("reason"),
        F.when(queue, revision).alias("job_revision"),
    )


def transition_candidates(tasks: DataFrame, board_id: str, limit: int | None = None) -> DataFrame:
    """Indexed active tasks in scan order."""
    found = tasks.filter(
        (F.col("board_id") == board_id)
        & (F.col("auto_sync_state") == "active")
        & (F.col("sync_status") == "completed")
        & (F.col("last_indexed_source_revision").isNotNull() | F.col("latest_snapshot_version").isNotNull())
    )
    return found if limit is None else found.orderBy("updated_at", KEY).limit(limit)


def transition_plan(tasks: DataFrame, current: DataFrame, policy: Policy, limit: int | None = None) -> DataFrame:
    """Completed-transition plan: where is the item of every indexed active task now?

    current: board_id, item_id, group_id; a task without a current item is an error row.
    """
    now_in = current.select("item_id", F.col("board_id").alias("_board"), F.col("group_id").alias("_group"), F.lit(True).alias("_seen"))
    df = transition_candidates(tasks, policy.board_id, limit).join(now_in, "item_id", "left")
    df = df.withColumn("_d", classify(policy, "_board", "_group"))
    state = F.col("_d.lifecycle_state")
    action = (
        F.when(F.col("_seen").isNull(), F.lit("error"))
        .when(state == "completed_retained", F.lit("would_mark_completed_retained"))
        .when(state == "excluded", F.lit("would_mark_excluded"))
        .when(state == "active", F.lit("still_active"))
        .otherwise("ignored")
    )
    return df.select(
        "item_id",
        KEY,
        F.col("_group").alias("group_id"),
        action.alias("action"),
        F.when(F.col("_seen"), F.col("_d.reason")).otherwise("item_missing").alias("reason"),
    )


def run_summary(plan: DataFrame, queued: Column, run: str | None = None) -> DataFrame:
    """Scanned / queued / skipped / error counts of a plan table."""
    error = F.col("action") == "error"
    aggregates = [
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(queued & ~error).alias("queued"),
        F.count_if(~queued & ~error).alias("skipped"),
        F.count_if(error).alias("errors"),
    ]
    return plan.groupBy(run).agg(*aggregates) if run else plan.agg(*aggregates)


def write_with_summary(plan: DataFrame, path: str, queued: Column, run: str, runs: Sequence[str]) -> DataFrame:
    """Writes a plan table and returns its ``run_summary`` for each of ``runs``, counted while it is written.

    The plan runs once: the counts are observed on the rows that go to the files. Runs without rows have no line.
    """
    error = F.coalesce(F.col("action") == "error", F.lit(False))
    measures = {"scanned": F.lit(True), "queued": queued & ~error, "skipped": ~queued & ~error, "errors": error}
    seen = Observation()
    counts = [F.count_if((F.col(run) == name) & measure).alias(f"{m}_{i}") for i, name in enumerate(runs) for m, measure in measures.items()]
    plan.observe(seen, *counts).write.mode("overwrite").parquet(path)
    found = seen.get
    rows = [(name, *[found[f"{m}_{i}"] for m in measures]) for i, name in enumerate(runs)]
    schema = f"{run} string, " + ", ".join(f"{m} long" for m in measures)
    return plan.sparkSession.createDataFrame([r for r in rows if r[1]], schema)


def action_counts(plan: DataFrame, action: str = "action", run: str | None = None) -> DataFrame:
    """Rows per action of a plan table: the counters of a run report."""
    keys = [run, action] if run else [action]
    return plan.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def policy_plan(
    items: DataFrame,
    tasks: DataFrame,
    jobs: DataFrame,
    policy: Policy,
    *,
    now: Column,
    trigger_type: str,
    schedule_immediately: bool = False,
) -> DataFrame:
    """Effect of the group policy on every current item.

    items: identity columns, ``desired_source_revision`` (nullable).
    One row per item: task action and its new dates, job action, jobs to cancel.
    """
    stored = tasks.select(
        KEY,
        F.lit(True).alias("_stored"),
        F.col("completed_at").alias("_completed_at"),
        F.col("purge_after").alias("_purge_after"),
        F.col("last_indexed_source_revision").alias("_indexed"),
    )
    first = pick_active_job(jobs, vocab.ACTIVE_SYNC_JOB_STATUSES).select(
        *PAIR, F.col("id").alias("job_id"), F.col("status").alias("_job_status"), F.col("desired_source_revision").alias("_job_revision")
    )
    df = items.join(stored, KEY, "left").join(first, PAIR, "left")
    df = df.withColumn("_d", classify(policy, "board_id", "group_id"))
    known = F.coalesce(F.col("_stored"), F.lit(False))
    state = F.col("_d.lifecycle_state")
    task_action = (
        F.when(~F.col("_d.should_track"), F.lit("none"))
        .when(F.col("_d.requires_index") & ~known, F.lit("none"))
        .when(state == "completed_retained", F.lit("retain"))
        .when(known, F.lit("update"))
        .otherwise("create")
    )
    df = df.withColumn("task_action", task_action)
    retained = F.col("task_action") == "retain"
    completed_at = F.when(retained, F.coalesce("_completed_at", now)).when(state != "active", F.col("_completed_at"))
    purge_after = F.when(retained, policy.purge_after(F.coalesce("_completed_at", now))).when(
        state != "active", F.col("_purge_after")
    )
    wants = F.col("_d.should_queue") & (F.col("task_action") != "none")
    indexed = F.coalesce(
        (F.length("desired_source_revision") > 0) & (F.col("_indexed") == F.col("desired_source_revision")), F.lit(False)
    )
    job_action = (
        F.when(~wants, F.lit("none"))
        .when(indexed, F.lit("skipped"))
        .when(F.col("job_id").isNull(), F.lit("create"))
        .when(F.col("_job_status") == "running", F.lit("retarget_running"))
        .otherwise("coalesce")
    )
    df = df.withColumn("job_action", job_action)
    delay = 0 if schedule_immediately else policy.debounce_seconds
    moved = F.col("job_action").isin("create", "coalesce")
    return df.select(
        *PAIR,
        KEY,
        "task_action",
        F.when(F.col("task_action") != "none", state).alias("lifecycle_state"),
        completed_at.alias("completed_at"),
        purge_after.alias("purge_after"),
        "job_action",
        F.when(F.col("job_action") != "create", F.col("job_id")).alias("job_id"),
        F.when(F.col("job_action").isin("create", "coalesce", "retarget_running"), F.lit(trigger_type)).alias("trigger_type"),
        F.when(
            F.col("job_action").isin("create", "coalesce", "retarget_running"),
            F.coalesce(F.nullif("desired_source_revision", F.lit("")), "_job_revision"),
        ).alias("job_revision"),
        F.when(moved, now + F.make_dt_interval(secs=F.lit(delay))).alias("scheduled_for"),
        (F.col("_d.should_cancel") & F.col("job_id").isNotNull()).alias("cancel_jobs"),
        F.col("_d.reason").alias("reason"),
    )


def sync_dispatch_outcome(events: DataFrame, plan: DataFrame, policy: Policy) -> DataFrame:
    """Outcome of the sync consumer for every event, from the policy plan of its item."""
    decided = plan.select("item_id", "job_action", "lifecycle_state", F.col("reason").alias("_reason"))
    df = events.join(decided, "item_id", "left")
    missing = F.coalesce(F.col("item_id"), F.lit("")) == ""
    elsewhere = ~F.col("board_id").eqNullSafe(F.lit(policy.board_id))
    outcome = (
        F.when(elsewhere | missing, F.lit("ignored"))
        .when(F.col("job_action") == "create", F.lit("queued"))
        .when(F.col("job_action").isin("coalesce", "retarget_running"), F.lit("coalesced"))
        .when(F.col("lifecycle_state") == "excluded", F.lit("excluded"))
        .when(F.col("_reason") == "auto_sync_disabled", F.lit("disabled"))
        .when(F.col("_reason").isNotNull(), F.lit("ignored"))
    )
    reason = (
        F.when(elsewhere, F.lit("board_not_managed")).when(missing, F.lit("missing_item_id")).otherwise(F.col("_reason"))
    )
    status = F.when(outcome.isNull(), F.lit("failed")).otherwise("succeeded")
    return df.select("event_id", F.lit("auto_sync").alias("consumer"), status.alias("status"), outcome.alias("outcome"), reason.alias("reason"))


def jobs_to_cancel(plan: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every active job of the items the plan cancels, with the reason."""
    doomed = plan.filter("cancel_jobs").select(*PAIR, F.col("reason").alias("last_error"))
    active = jobs.filter(F.col("status").isin(*vocab.ACTIVE_SYNC_JOB_STATUSES))
    return active.select("id", *PAIR).join(doomed, PAIR).select("id", *PAIR, F.lit("cancelled").alias("status"), "last_error")


def task_status(tasks: DataFrame, jobs: DataFrame, error_chars: int | None = None) -> DataFrame:
    """Task status derived from its latest job; error texts are whole unless cut to ``error_chars``.

    jobs: external_task_key, id, status, result, last_error, trigger_type,
    desired_source_revision, changed_at.
    """
    order = [F.col("changed_at").desc(), F.col("id").desc()]
    last = keep_first(jobs, [KEY], order).select(
        KEY, F.col("status").alias("_job"), "result", "last_error", "trigger_type", "changed_at", "desired_source_revision"
    )
    df = tasks.select(KEY, F.col("last_indexed_source_revision").alias("_indexed")).join(last, KEY)
    job = F.col("_job")
    status = (
        F.when(job.isin("pending", "scheduled"), F.lit("queued"))
        .when(job == "running", F.lit("syncing"))
        .when(job.isin("completed", "skipped"), F.lit("completed"))
        .when(job.isin("failed", "retry_wait"), F.lit("failed"))
    )
    result = (
        F.when(job == "skipped", F.lit("skipped"))
        .when(job == "completed", F.coalesce("result", F.lit("done")))
        .when(job.isin("failed", "retry_wait"), F.lit("failed"))
    )
    finished = job.isin("completed", "skipped", "failed", "retry_wait")
    return df.select(
        KEY,
        status.alias("sync_status"),
        result.alias("last_sync_result"),
        F.when(finished, F.col("changed_at")).alias("sync_finished_at"),
        F.when(job.isin("failed", "retry_wait"), F.col("last_error") if error_chars is None else F.substring("last_error", 1, error_chars)).alias("sync_error"),
        F.col("trigger_type").alias("last_sync_trigger"),
        F.when(job.isin("completed", "skipped"), F.coalesce("desired_source_revision", "_indexed"))
        .otherwise(F.col("_indexed"))
        .alias("last_indexed_source_revision"),
    )


def due_for_purge(tasks: DataFrame, board_id: str, now: Column, limit: int | None = None) -> DataFrame:
    """Tasks whose retention ended, in purge order; an unknown hold counts as not held."""
    due = tasks.filter(
        (F.col("board_id") == board_id)
        & F.col("auto_sync_state").isin(*vocab.PURGE_ELIGIBLE_STATES)
        & ~F.coalesce("retention_hold", F.lit(False))
        & (F.col("purge_after") <= now)
    )
    return due if limit is None else due.orderBy("purge_after", "updated_at", KEY).limit(limit)


def delete_manifest(due: DataFrame, files: DataFrame) -> DataFrame:
    """Stored objects of the due tasks that are not deleted yet."""
    live = files.filter(F.col("deleted_at").isNull() & (F.col("storage_status") == "stored"))
    return live.join(due.select(KEY), KEY, "left_semi").select("id", KEY, "bucket", "object_path", "created_at")


def purge_outcome(due: DataFrame, manifest: DataFrame, results: DataFrame) -> DataFrame:
    """Per due task: expired, or still deleting because an object could not be removed.

    results: id, error (NULL on success) of every manifest row tried. A row
    without a result counts as not deleted.
    """
    tried = manifest.join(results.select("id", "error", F.lit(True).alias("_tried")), "id", "left")
    counted = tried.groupBy(KEY).agg(
        F.count_if(F.col("_tried").isNotNull() & F.col("error").isNull()).alias("files_deleted"),
        F.count_if(F.col("_tried").isNull() | F.col("error").isNotNull()).alias("files_failed"),
    )
    df = due.select(KEY).join(counted, KEY, "left").fillna(0, ["files_deleted", "files_failed"])
    failed = F.col("files_failed") > 0
    error = F.concat(
        F.lit("Purge failed to delete "), F.col("files_failed").cast("string"), F.lit(" Storage object(s)")
    )
    return df.select(
        KEY,
        "files_deleted",
        "files_failed",
        F.when(failed, F.lit("storage_failed")).otherwise("expired").alias("action"),
        F.when(failed, F.lit("storage_deleting")).otherwise("expired").alias("auto_sync_state"),
        F.when(failed, error).alias("sync_error"),
    )


def tombstones(tasks: DataFrame, outcome: DataFrame, now: Column) -> DataFrame:
    """Task rows after the purge; other tasks are unchanged."""
    done = outcome.select(KEY, F.col("auto_sync_state").alias("_state"), F.col("sync_error").alias("_error"))
    df = tasks.join(done, KEY, "left")
    gone, tried = F.col("_state") == "expired", F.col("_state").isNotNull()
    new = {
        "auto_sync_state": F.coalesce("_state", "auto_sync_state"),
        "sync_error": F.when(tried, F.col("_error")).otherwise(F.col("sync_error")),
        "raw_purged_at": F.when(gone, now).otherwise(F.col("raw_purged_at")),
        "latest_snapshot_version": F.when(~F.coalesce(gone, F.lit(False)), F.col("latest_snapshot_version")),
        "sync_status": F.when(gone, F.lit("completed")).otherwise(F.col("sync_status")),
        "sync_finished_at": F.when(gone, now).otherwise(F.col("sync_finished_at") if "sync_finished_at" in tasks.columns else F.lit(None)),
        "last_sync_result": F.when(gone, F.lit("skipped")).otherwise(F.col("last_sync_result")),
        "updated_at": F.when(tried, now).otherwise(F.col("updated_at")),
    }
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in tasks.columns])


def rows_kept(table: DataFrame, outcome: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """A heavy table without the rows of expired tasks.

    ``files`` leads from a chunk table (``file_id``) to its task.
    """
    gone = outcome.filter(F.col("action") == "expired").select(KEY)
    if files is None:
        return table.join(gone, KEY, "left_anti")
    dead = files.join(gone, KEY, "left_semi").select(F.col("id").alias("file_id"))
    return table.join(dead, "file_id", "left_anti")


def retention_clock(tasks: DataFrame, access: DataFrame, policy: Policy) -> DataFrame:
    """Effect of accesses, holds, releases and restores on the purge date.

    access: external_task_key, accessed_at, kind ('access' | 'hold' | 'release' | 'restore').
    The newest access extends the date of retained tasks without a hold; an
    expired task becomes retained again on restore.
    """
    by_key = access.groupBy(KEY).agg(
        F.max(F.when(F.col("kind").isin("access", "hold", "restore"), F.col("accessed_at"))).alias("_at"),
        F.max(F.when(F.col("kind") == "restore", F.col("accessed_at"))).alias("_restored"),
        F.max_by("kind", F.when(F.col("kind").isin("hold", "release"), F.col("accessed_at"))).alias("_hold"),
    )
    df = tasks.join(by_key, KEY, "left")
    hold = (
        F.when(F.col("_hold") == "hold", True).when(F.col("_hold") == "release", False).otherwise(F.col("retention_hold"))
    )
    restored = (F.col("auto_sync_state") == "expired") & F.col("_restored").isNotNull()
    state = F.when(restored, F.lit("completed_retained")).otherwise(F.col("auto_sync_state"))
    extended = (state == "completed_retained") & F.col("_at").isNotNull() & ~F.coalesce(hold, F.lit(False))
    purge = (
        F.when(restored, policy.purge_after(F.col("_restored")))
        .when(extended, policy.purge_after(F.col("_at")))
        .otherwise(F.col("purge_after"))
    )
    return df.select(
        KEY,
        state.alias("auto_sync_state"),
        hold.alias("retention_hold"),
        F.when(restored, F.coalesce("completed_at", "_restored")).otherwise(F.col("completed_at")).alias("completed_at"),
        purge.alias("purge_after"),
        F.col("_at").alias("last_meaningful_access_at"),
    )


def freshness(tasks: DataFrame, snapshots: DataFrame, current: DataFrame, force: bool = False) -> DataFrame:
    """Is the stored content current, and is a refresh due?

    current: external_task_key, source_revision (NULL when it could not be read).
    """
    complete = (
        snapshots.filter(F.col("ingestion_status") == "complete")
        .select(KEY, F.col("snapshot_version").alias("source_revision"))
        .distinct()
        .withColumn("_complete", F.lit(True))
    )
    df = tasks.join(current.select(KEY, "source_revision"), KEY, "left").join(complete, [KEY, "source_revision"], "left")
    fresh = (
        F.coalesce((F.col("sync_status") == "completed"), F.lit(False))
        & ~F.coalesce(F.col("auto_sync_state") == "expired", F.lit(False))
        & F.coalesce(F.length("source_revision") > 0, F.lit(False))
        & indexed_at("source_revision")
        & F.coalesce(F.col("_complete"), F.lit(False))
    )
    busy = F.coalesce(F.col("sync_status").isin("queued", "syncing"), F.lit(False))
    return df.select(KEY, fresh.alias("fresh"), ((F.lit(force) | ~fresh) & ~busy).alias("refresh_due"))


def needs_ingest(wanted: DataFrame, snapshots: DataFrame, force: bool = False) -> DataFrame:
    """Incremental skip: items whose revision has no complete snapshot yet.

    wanted: external_task_key, source_revision. Runs before any expensive step.
    """
    if force:
        return wanted
    done = snapshots.filter(F.col("ingestion_status") == "complete").select(
        KEY, F.col("snapshot_version").alias("source_revision")
    )
    return wanted.join(done, [KEY, "source_revision"], "left_anti")


def task_sources(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """Files of the latest complete snapshot of every task, with a download flag."""
    latest = latest_complete(snapshots).select(KEY, F.col("id").alias("snapshot_id"), "snapshot_version")
    return files.join(latest, [KEY, "snapshot_id"]).withColumn(
        "download_available", F.coalesce(F.col("storage_status") == "stored", F.lit(False))
    )


def task_summary(tasks: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Summary row of every task; the snapshot version is NULL before the first one."""
    latest = latest_complete(snapshots).select(KEY, "snapshot_version")
    return tasks.join(latest, KEY, "left")


def visible_tasks(tasks: DataFrame, links: DataFrame, user_id: str) -> DataFrame:
    """Tasks of the accounts the user is linked to."""
    mine = links.filter(F.col("user_id") == user_id).select("account_id")
    return tasks.join(mine, "account_id", "left_semi")


def snapshot_keepers(snapshots: DataFrame) -> DataFrame:
    """Duplicates of (task, version) and the snapshot that stays: duplicate_id, keeper_id."""
    keys = [KEY, "snapshot_version"]
    keeper = keep_first(snapshots, keys, [F.col("created_at").desc(), F.col("id").desc()])
    pairs = snapshots.select(*keys, F.col("id").alias("duplicate_id")).join(
        keeper.select(*keys, F.col("id").alias("keeper_id")), keys
    )
    return pairs.filter("duplicate_id <> keeper_id").select("duplicate_id", "keeper_id")


def deduplicate_snapshots(snapshots: DataFrame, files: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Snapshots, files and chunks after merging duplicate snapshots.

    A file of a duplicate moves to the keeper unless the keeper holds the same
    asset; of several duplicates that hold it, the file of the latest snapshot moves, in
    the order in which the keeper was chosen. All other files of duplicates go, with their chunks.
    Files without an asset id are no copies of one another.
    """
    order = snapshots.select(F.col("id").alias("duplicate_id"), F.col("created_at").alias("_created"))
    pairs = snapshot_keepers(snapshots)
    mapped = files.join(pairs.join(order, "duplicate_id").withColumnRenamed("duplicate_id", "snapshot_id"), "snapshot_id", "left")
    kept = files.select(F.col("snapshot_id").alias("keeper_id"), KEY, "asset_id").distinct()
    asset = ["keeper_id", KEY, "asset_id"]
    movable = mapped.filter("keeper_id is not null and asset_id is not null")
    first = keep_first(movable.join(kept, asset, "left_anti"), asset, [F.col("_created").desc(), F.col("snapshot_id").desc(), F.col("id")])
    clash = movable.select("id").join(first.select("id"), "id", "left_anti")
    moved = (
        mapped.join(clash, "id", "left_anti")
        .withColumn("snapshot_id", F.coalesce("keeper_id", "snapshot_id"))
        .select(*files.columns)
    )
    left = chunks.join(clash.withColumnRenamed("id", "file_id"), "file_id", "left_anti")
    stays = snapshots.join(pairs.select(F.col("duplicate_id").alias("id")), "id", "left_anti")
    return stays, moved, left
