"""Decision tables of the design processing (table in, plan table out)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from worklens import vocab
from worklens.functions.dates import plus_seconds
from worklens.functions.values import label_id, is_missing, retry_delay_seconds
from worklens.functions.dates import flexible_date, hour_minute
from worklens.functions.text import col
from worklens.plans import policy as rules
from worklens.scale import keep_first

PAIR = ["board_id", "item_id"]


def pick_active_job(jobs: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """The oldest active job of every item, ties by id."""
    active = jobs.filter(F.col("status").isin(*statuses))
    return keep_first(active, PAIR, [F.col("created_at"), F.col("id")])


def obligations(items: DataFrame, mode: str, allowlist=None) -> DataFrame:
    """Next obligation of every item."""
    flagged = rules.with_allowlist(items, allowlist)
    due = rules.next_obligation("desired", "analyzed", "published", rules.publication_allowed(mode, "listed"))
    return flagged.withColumn("obligation", due).drop("listed")


def due_jobs(jobs: DataFrame, now: Column, limit: int, waiting: tuple[str, ...] = ("scheduled",)) -> DataFrame:
    """The next ``limit`` jobs a worker may claim, in claim order."""
    ready = (F.col("status").isin(*waiting) & (F.col("scheduled_for") <= now)) | (
        (F.col("status") == "retry_wait") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))
    )
    return jobs.filter(ready).orderBy("scheduled_for", "created_at", "id").limit(limit)


def analysis_or_readiness(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs that are analysis, or unassigned while the analysis is not current.

    The comparison follows SQL three-valued logic on purpose.
    """
    d, a = "_i.desired", "_i.analyzed"
    open_analysis = (
        F.col(f"{d}.input_revision").isNull()
        | F.col(f"{a}.input_revision").isNull()
        | (F.col(f"{a}.input_revision") != F.col(f"{d}.input_revision"))
        | (F.col(f"{a}.pipeline_version") != F.col(f"{d}.pipeline_version"))
    )
    pairs = items.select(*PAIR, F.struct("desired", "analyzed").alias("_i"))
    joined = jobs.join(pairs, PAIR)
    keep = (F.col("execution_kind") == "analysis") | (F.col("execution_kind").isNull() & open_analysis)
    return joined.filter(keep).drop("_i")


def expired_leases(
    jobs: DataFrame,
    now: Column,
    variant: str,
    lease_seconds: int = vocab.LEASE_SECONDS,
    limit: int | None = None,
) -> DataFrame:
    """Running jobs whose lease is over.

    ``sync``: an old lock counts even with a fresh heartbeat. ``design``: the
    lock counts only without a heartbeat.
    """
    cutoff = now - F.make_dt_interval(secs=F.lit(lease_seconds))
    locked, beat = F.col("locked_at"), F.col("heartbeat_at")
    expired = locked.isNull() | (beat <= cutoff)
    if variant == "sync":
        expired = expired | (locked <= cutoff)
    elif variant == "design":
        expired = expired | (beat.isNull() & (locked <= cutoff))
    else:
        raise ValueError("variant must be 'sync' or 'design'")
    found = jobs.filter((F.col("status") == "running") & expired)
    return found if limit is None else found.orderBy("locked_at", "id").limit(limit)


def queue_plan(
    snapshots: DataFrame,
    items: DataFrame,
    jobs: DataFrame,
    *,
    mode: str,
    pipeline_version: str,
    board_id: str,
    group_id: str,
    allowlist=None,
) -> DataFrame:
    """Outcome of queueing every current snapshot against stored items and active jobs.

    snapshots: item_id, board_id, group_id, item_state, missing_name, missing_email, input_revision
    items: board_id, item_id, state, desired, analyzed, published
    jobs: active or not; board_id, item_id, id, status, execution_kind, execution, created_at
    """
    stored = items.filter(F.col("board_id") == board_id).select(
        "item_id",
        F.col("state").alias("_state"),
        F.col("desired").alias("_before"),
        F.col("analyzed").alias("_analyzed"),
        F.col("published").alias("_published"),
        F.lit(True).alias("_stored"),
    )
    active = pick_active_job(jobs.filter(F.col("board_id") == board_id), vocab.ACTIVE_DESIGN_JOB_STATUSES).select(
        "item_id",
        F.col("id").alias("job_id"),
        F.col("status").alias("_status"),
        F.col("execution_kind").alias("_kind"),
        F.col("execution").alias("_execution"),
    )
    df = snapshots.join(stored, "item_id", "left").join(active, "item_id", "left")
    df = rules.with_allowlist(df, allowlist)

    readiness = rules.target_readiness(board_id, group_id)
    df = df.withColumn("readiness", readiness).withColumn("_allowed", rules.publication_allowed(mode, "listed"))
    desired = F.when(F.col("readiness") == "ready", rules.identity("input_revision", F.lit(pipeline_version)))
    df = df.withColumn("_desired", desired)
    df = df.withColumn(
        "_requires",
        F.col("readiness").isin(*vocab.READINESS_STAGES)
        | rules.next_obligation("_desired", "_analyzed", "_published", "_allowed").isNotNull(),
    )
    has_job = F.col("job_id").isNotNull()
    elsewhere = ~F.col("board_id").eqNullSafe(F.lit(board_id)) | ~F.col("group_id").eqNullSafe(F.lit(group_id))
    running = has_job & (F.col("_status") == "running")
    assigned = has_job & ~running & F.col("_execution").isNotNull()
    replaced = assigned & (
        ~rules.same("_execution", "_desired") | ((F.col("_kind") == "publication") & ~F.col("_allowed"))
    )
    off = F.lit(mode == "off")
    known = F.coalesce(F.col("_stored"), F.lit(False))
    df = df.withColumn("_replaced", replaced)

    outcome = (
        F.when(off, F.lit("disabled"))
        .when(elsewhere, F.lit("excluded"))
        .when(running, F.lit("coalesced"))
        .when(has_job & ~F.col("_replaced"), F.lit("coalesced"))
        .when(has_job & F.col("_requires"), F.lit("coalesced"))
        .when(F.col("_requires"), F.lit("queued"))
        .otherwise("ignored")
    )
    cancel = ~off & has_job & F.when(elsewhere, known).otherwise(~running & F.col("_replaced"))
    create = (
        ~off
        & ~elsewhere
        & ~running
        & F.col("_requires")
        & (~has_job | F.col("_replaced"))
    )
    changed = ~rules.same("_before", "_desired")
    base = F.coalesce(F.col("_state"), F.lit("scheduled"))
    restarted = changed & F.col("_desired").isNotNull() & ~rules.same("_desired", "_published")
    running_state = F.when(F.col("_kind") == "publication", F.lit("publishing")).otherwise("processing")
    woken = changed & base.isin(*vocab.READINESS_STAGES, "ineligible", "failed")
    refreshed = (
        F.when(F.col("readiness") != "ready", F.col("readiness"))
        .when(restarted & running, running_state)
        .when(restarted | woken, F.lit("scheduled"))
        .otherwise(base)
    )
    unpublished = (
        F.col("_desired").isNotNull()
        & rules.same("_analyzed", "_desired")
        & ~rules.same("_published", "_desired")
    )
    state = (
        F.when(off, F.col("_state"))
        .when(elsewhere, F.when(known, F.lit("ineligible")))
        .when((outcome == "ignored") & unpublished, F.lit("analyzed"))
        .when(F.col("_replaced") & (F.col("readiness") == "ready"), F.lit("scheduled"))
        .otherwise(refreshed)
    )
    superseding = running & F.col("_execution").isNotNull() & changed & ~rules.same("_execution", "_desired")
    return df.select(
        "item_id",
        outcome.alias("outcome"),
        F.when(off, F.lit(None)).otherwise(F.col("readiness")).alias("readiness"),
        F.when(~off & ~elsewhere, F.col("_desired")).alias("desired"),
        F.coalesce(cancel, F.lit(False)).alias("cancel_job"),
        F.coalesce(create, F.lit(False)).alias("create_job"),
        F.coalesce(~off & superseding, F.lit(False)).alias("request_supersession"),
        state.alias("item_state"),
    )


def landing_plan(
    group_items: DataFrame,
    snapshots: DataFrame,
    items: DataFrame,
    jobs: DataFrame,
    *,
    activation: Column,
    limit: int | None = None,
    **settings,
) -> DataFrame:
    """Dry-run reconciliation of the landing group from the activation time on.

    group_items: item_id, created_at (timestamp), source_pos. With a limit the
    scan stops after that many candidates, so later rows are not reported.
    """
    late = F.col("created_at") >= activation
    if limit is not None:
        # One number: the position of the last candidate, NULL when all fit.
        reached = group_items.filter(late).orderBy("source_pos").limit(limit)
        last = reached.agg(F.when(F.count(F.lit(1)) >= limit, F.max("source_pos")))
        group_items = group_items.filter(F.col("source_pos") <= F.coalesce(last.scalar(), F.col("source_pos")))
    skipped = group_items.filter(~late).select(
        "item_id", F.lit("skipped").alias("action"), F.lit("before_activation_timestamp").alias("reason")
    )
    chosen = group_items.filter(late).select("item_id")
    plan = queue_plan(snapshots.join(chosen, "item_id", "left_semi"), items, jobs, **settings)
    planned = plan.select(
        "item_id",
        F.concat(F.lit("would_"), F.col("outcome")).alias("action"),
        F.coalesce("readiness", "outcome").alias("reason"),
    )
    return skipped.unionByName(planned)


def lease_recovery_plan(
    jobs: DataFrame, items: DataFrame, *, now: Column, mode: str, allowlist=None, lease_seconds: int = vocab.LEASE_SECONDS, limit: int | None = None
) -> DataFrame:
    """What to do with every expired design lease."""
    expired = expired_leases(jobs, now, "design", lease_seconds, limit)
    state = items.select(*PAIR, F.col("state").alias("_state"), F.col("desired").alias("_desired"))
    df = rules.with_allowlist(expired.join(state, PAIR), allowlist)
    kind = F.coalesce("execution_kind", F.lit("analysis"))
    waiting = F.col("_state").isin(*vocab.READINESS_STAGES)
    allowed = rules.execution_allowed(mode, kind, "listed")
    assigned = F.col("execution").isNotNull()
    action = (
        F.when(~allowed, F.lit("cancel"))
        .when(assigned & ~rules.same("execution", "_desired"), F.lit("replace"))
        .when(~assigned, F.lit("reschedule"))
        .when(F.col("attempt_count") >= F.col("max_attempts"), F.lit("fail"))
        .otherwise("retry")
    )
    df = df.withColumn("action", action)
    fallback = F.when(waiting, F.col("_state")).otherwise("scheduled")
    item_state = (
        F.when((F.col("action") == "cancel") & (kind == "publication"), F.lit("analyzed"))
        .when(F.col("action") == "cancel", fallback)
        .when((F.col("action") == "replace") & waiting, F.col("_state"))
        .when((F.col("action") == "replace") & F.col("_desired").isNull(), F.lit("waiting_for_email"))
        .when(F.col("action") == "replace", F.lit("scheduled"))
        .when(F.col("action") == "fail", F.lit("failed"))
        .when(F.col("action") == "retry", F.when(kind == "analysis", F.lit("processing")).otherwise("publishing"))
        .otherwise(F.col("_state"))
    )
    return df.select("id", *PAIR, "action", item_state.alias("item_state"))


def sync_lease_recovery_plan(jobs: DataFrame, *, now: Column, lease_seconds: int = vocab.LEASE_SECONDS, limit: int | None = None) -> DataFrame:
    """Expired sync leases fail when no attempt is left, else wait for a retry now."""
    expired = expired_leases(jobs, now, "sync", lease_seconds, limit)
    last = F.col("attempt_count") >= F.col("max_attempts")
    return expired.select(
        "id",
        *PAIR,
        F.when(last, F.lit("failed")).otherwise("retry_wait").alias("next_status"),
        F.when(~last, now).alias("next_retry_at"),
        F.lit("Worker lease expired").alias("last_error"),
    )


def failure_plan(jobs: DataFrame, *, now: Column, side: str) -> DataFrame:
    """Next status and retry time of jobs whose run just failed.

    ``sync``: attempts were counted at the claim. ``design``: an unassigned job
    counts the attempt here, an assigned one was counted when it was assigned.
    """
    attempts = F.col("attempt_count")
    if side == "design":
        attempts = F.when(F.col("execution").isNull(), attempts + 1).otherwise(attempts)
    elif side != "sync":
        raise ValueError("side must be 'sync' or 'design'")
    done = attempts >= F.col("max_attempts")
    return jobs.select(
        "id",
        *PAIR,
        attempts.alias("attempt_count"),
        F.when(done, F.lit("failed")).otherwise("retry_wait").alias("next_status"),
        F.when(~done, plus_seconds(now, retry_delay_seconds(attempts))).alias("next_retry_at"),
    )


def operator_retry_plan(failed: DataFrame, jobs: DataFrame, items: DataFrame, *, mode: str, allowlist=None) -> DataFrame:
    """Which failed jobs may be started again by hand, and why not."""
    active = (
        jobs.filter(F.col("status").isin(*vocab.ACTIVE_DESIGN_JOB_STATUSES))
        .select(*PAIR)
        .distinct()
        .withColumn("_active", F.lit(True))
    )
    state = items.select(*PAIR, F.col("desired").alias("_desired"))
    df = rules.with_allowlist(failed.join(active, PAIR, "left").join(state, PAIR), allowlist)
    kind = F.coalesce("execution_kind", F.lit("analysis"))
    outcome = (
        F.when(F.col("_active"), F.lit("coalesced"))
        .when(F.col("status") != "failed", F.lit("refused_not_failed"))
        .when(
            F.col("execution").isNotNull() & ~rules.same("execution", "_desired"), F.lit("refused_superseded")
        )
        .when(~rules.execution_allowed(mode, kind, "listed"), F.lit("refused_by_mode"))
        .otherwise("scheduled")
    )
    df = df.withColumn("outcome", outcome)
    go = F.col("outcome") == "scheduled"
    return df.select(
        "id",
        *PAIR,
        "outcome",
        F.when(go, F.greatest("max_attempts", F.col("attempt_count") + 1))
        .otherwise(F.col("max_attempts"))
        .alias("max_attempts"),
        F.when(go, F.when(kind == "publication", F.lit("analyzed")).otherwise("scheduled")).alias("item_state"),
    )


def execution_gate(
    jobs: DataFrame,
    items: DataFrame,
    snapshots: DataFrame,
    *,
    worker_id: Column | str,
    mode: str,
    pipeline_version: str,
    board_id: str,
    group_id: str,
    allowlist=None,
) -> DataFrame:
    """First failed check of every running job and what follows from it."""
    state = items.select(*PAIR, F.col("desired").alias("_desired"), F.col("published").alias("_published"))
    current = snapshots.select(
        "item_id",
        F.col("board_id").alias("_board"),
        F.col("group_id").alias("_group"),
        "item_state",
        "missing_name",
        "missing_email",
        F.col("input_revision").alias("_revision"),
    )
    df = rules.with_allowlist(jobs.join(state, PAIR).join(current, "item_id"), allowlist)
    df = df.withColumn("_ready", rules.target_readiness(board_id, group_id, "_board", "_group"))
    kind = F.coalesce("execution_kind", F.lit("analysis"))
    allowed = rules.execution_allowed(mode, kind, "listed")
    owner = F.lit(worker_id) if isinstance(worker_id, str) else worker_id
    lost = ~F.col("status").eqNullSafe(F.lit("running")) | ~F.col("locked_by").eqNullSafe(owner)
    not_ready = (F.col("_ready") != "ready") | F.col("_revision").isNull()
    mismatch = (
        F.when(lost, F.lit("lease_lost"))
        .when(~allowed, F.lit("execution_disabled"))
        .when(F.col("execution").isNull(), F.lit("execution_unassigned"))
        .when(~rules.same("execution", "_desired"), F.lit("stored_identity_changed"))
        .when(F.col("execution.pipeline_version") != pipeline_version, F.lit("pipeline_changed"))
        .when(not_ready, F.col("_ready"))
        .when(F.col("_revision") != F.col("execution.input_revision"), F.lit("input_changed"))
    )
    # The stored target is refreshed from the snapshot before the job is re-judged.
    fresh = F.when(F.col("_ready") == "ready", rules.identity("_revision", F.lit(pipeline_version)))
    df = df.withColumn("mismatch", mismatch).withColumn("_fresh", fresh)
    action = (
        F.when(F.col("mismatch").isNull(), F.lit("run"))
        .when(lost, F.lit("not_claimed"))
        .when(~allowed, F.lit("cancel"))
        .when(F.col("_ready") == "ineligible", F.lit("cancel_ineligible"))
        .when(F.col("execution").isNull(), F.lit("cancel"))
        .when(rules.same("execution", "_fresh") & (F.col("attempt_count") >= F.col("max_attempts")), F.lit("fail"))
        .when(rules.same("execution", "_fresh"), F.lit("retry"))
        .otherwise("replace")
    )
    return df.select("id", *PAIR, "mismatch", action.alias("action"))


def publication_payload(parameters: DataFrame, settings: Column | str) -> DataFrame:
    """Owned column values and warnings per item.

    parameters: item_id, date_received, hour_received, post_code (raw values).
    """
    settings = F.lit(settings) if isinstance(settings, str) else settings
    date = F.nullif(F.when(~is_missing("date_received"), flexible_date("date_received")), F.lit(""))
    hour = F.when(~is_missing("hour_received"), hour_minute("hour_received"))
    zip_id = F.when(~is_missing("post_code"), label_id("post_code", settings))
    staged = parameters.select("item_id", date.alias("date"), hour.alias("hour"), zip_id.alias("zip_id"))
    warnings = F.array_compact(
        F.array(
            F.when(F.col("date").isNull(), F.lit(vocab.WARN_DATE)),
            F.when(F.col("hour").isNull(), F.lit(vocab.WARN_HOUR)),
            F.when(F.col("zip_id").isNull(), F.lit(vocab.WARN_ZIP)),
        )
    )
    return staged.withColumn("warnings", warnings)


def column_writes(payload: DataFrame) -> DataFrame:
    """Long form of the payload: item_id, column_id, value (JSON text)."""
    values = F.array(
        F.struct(F.lit(vocab.DATE_COLUMN).alias("column_id"), F.to_json(F.struct(F.col("date"))).alias("value"), F.col("date").isNotNull().alias("ok")),
        F.struct(F.lit(vocab.HOUR_COLUMN).alias("column_id"), F.to_json(F.col("hour")).alias("value"), F.col("hour").isNotNull().alias("ok")),
        F.struct(
            F.lit(vocab.ZIP_COLUMN).alias("column_id"),
            F.to_json(F.struct(F.array("zip_id").alias("ids"))).alias("value"),
            F.col("zip_id").isNotNull().alias("ok"),
        ),
    )
    return payload.select("item_id", F.explode(values).alias("w")).filter("w.ok").select("item_id", "w.column_id", "w.value")


def write_violations(writes: DataFrame, owned: tuple[str, ...] = vocab.OWNED_COLUMNS) -> DataFrame:
    """Writes outside the owned columns, or that would clear a value."""
    rule = F.when(~F.col("column_id").isin(*owned), F.lit("column_not_owned")).when(
        F.col("value").isNull() | (F.col("value") == ""), F.lit("clears_value")
    )
    return writes.withColumn("violation", rule).filter(F.col("violation").isNotNull())


def complete_identities(artifacts: DataFrame) -> DataFrame:
    """Identities with every required artifact published and uploaded."""
    keys = [*PAIR, "input_revision", "pipeline_version"]
    required = F.lit(False)
    for kind, column in vocab.REQUIRED_ARTIFACTS:
        required = required | ((F.col("artifact_kind") == kind) & (F.col("column_id") == column))
    done = artifacts.filter(required & (F.col("status") == "published") & F.col("asset_id").isNotNull())
    # One flag per required pair, so no distinct set is built.
    flags = [
        F.max(F.when(F.col("artifact_kind") == kind, 1).otherwise(0)).alias(f"_{kind}")
        for kind, _ in vocab.REQUIRED_ARTIFACTS
    ]
    total = sum((F.col(f"_{kind}") for kind, _ in vocab.REQUIRED_ARTIFACTS), F.lit(0))
    return done.groupBy(*keys).agg(*flags).filter(total == len(vocab.REQUIRED_ARTIFACTS)).select(*keys)


def ready_for_review(items: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Items whose desired identity is published with all required artifacts."""
    current = items.filter(F.col("desired").isNotNull() & rules.same("desired", "published"))
    keyed = current.select(*current.columns, "published.input_revision", "published.pipeline_version")
    keys = [*PAIR, "input_revision", "pipeline_version"]
    return keyed.join(complete_identities(artifacts), keys, "left_semi").select(*items.columns)


def supersede_artifacts(artifacts: DataFrame, items: DataFrame) -> DataFrame:
    """Published artifacts of identities other than the current one: to be deleted."""
    current = items.filter(F.col("published").isNotNull()).select(*PAIR, F.col("published").alias("_current"))
    mine = F.struct("input_revision", "pipeline_version")
    live = artifacts.filter((F.col("status") == "published") & F.col("asset_id").isNotNull())
    prior = live.join(current, PAIR).filter(~mine.eqNullSafe(F.col("_current"))).drop("_current")
    return prior.withColumn("status", F.lit("delete_pending")).withColumn("last_error", F.lit(None).cast("string"))


def cleanup_plan(artifacts: DataFrame, items: DataFrame, column_files: DataFrame) -> DataFrame:
    """Deletable artifacts and the reason when one has to stay.

    column_files: board_id, item_id, column_id, asset_id currently shown on the board.
    """
    pending = artifacts.filter(F.col("status") == "delete_pending")
    published = items.select(*PAIR, F.col("published").alias("_published"))
    complete = complete_identities(artifacts).select(
        *PAIR, rules.identity("input_revision", "pipeline_version").alias("_published"), F.lit(True).alias("_complete")
    )
    column = [*PAIR, "column_id"]
    shown = column_files.groupBy(*column).agg(F.count(F.lit(1)).alias("_files"))
    here = column_files.select(*column, "asset_id").distinct().withColumn("_here", F.lit(True))
    df = (
        pending.join(published, PAIR)
        .join(complete, [*PAIR, "_published"], "left")
        .join(shown, column, "left")
        .join(here, [*column, "asset_id"], "left")
    )
    mine = F.struct("input_revision", "pipeline_version")
    verdict = (
        F.when(F.col("_published").isNull() | F.col("_published").eqNullSafe(mine), F.lit("cleanup_replacement_missing"))
        .when(F.col("_complete").isNull(), F.lit("cleanup_replacement_incomplete"))
        .when(F.col("_here").isNull(), F.lit("already_gone"))
        .when(F.col("_files") <= 1, F.lit("last_file_kept"))
        .otherwise("delete")
    )
    return df.select("id", *PAIR, "column_id", "asset_id", "updated_at", verdict.alias("verdict"))


def adoption_plan(artifacts: DataFrame, assets: DataFrame) -> DataFrame:
    """Upload, adopt or refuse, by comparing artifacts with the files of their column.

    assets: board_id, item_id, column_id, filename, size_bytes, asset_id.
    """
    keys = [*PAIR, "column_id", "deterministic_filename"]
    theirs = assets.select(
        *PAIR,
        "column_id",
        F.col("filename").alias("deterministic_filename"),
        F.col("size_bytes").alias("_size"),
        F.col("asset_id").alias("_asset"),
    )
    mine = artifacts.select("id", "size_bytes", "status", *keys)
    fits = F.col("_size").isNull() | (F.col("_size") == F.col("size_bytes"))
    counted = (
        mine.join(theirs, keys, "left")
        .groupBy("id", "status", *PAIR)
        .agg(
            F.count("_asset").alias("_named"),
            F.count(F.when(fits, F.col("_asset"))).alias("_fitting"),
            F.min(F.when(fits, F.col("_asset"))).alias("_chosen"),
        )
    )
    verdict = (
        F.when(~F.col("status").isin("uploading", "failed", "published"), F.lit("wrong_status"))
        .when(F.col("_fitting") > 1, F.lit("ambiguous"))
        .when((F.col("_named") > 0) & (F.col("_fitting") == 0), F.lit("wrong_size"))
        .when(F.col("_fitting") == 1, F.lit("adopt"))
        .otherwise("upload")
    )
    asset = F.when((F.col("_fitting") == 1) & (verdict == "adopt"), F.col("_chosen"))
    return counted.select("id", *PAIR, verdict.alias("verdict"), asset.alias("asset_id"))


def reusable_stages(wanted: DataFrame, outputs: DataFrame, stage: str) -> DataFrame:
    """Work still to do for a stage: identities without a stored output of it."""
    keys = [*PAIR, "input_revision", "pipeline_version"]
    done = outputs.filter(F.col("stage") == stage).select(*keys)
    return wanted.join(done, keys, "left_anti")


def dispatch_outcome(
    events: DataFrame, plan: DataFrame, *, mode: str, board_id: str, trigger: str = "trigger_type"
) -> DataFrame:
    """Outcome and reason of the design consumer for every event.

    events: event_id, board_id, item_id, trigger_type; plan: output of ``queue_plan``.
    """
    decided = plan.select("item_id", F.col("outcome").alias("_outcome"), F.col("readiness").alias("_readiness"))
    df = events.join(decided, "item_id", "left")
    missing = F.coalesce(F.col("item_id"), F.lit("")) == ""
    elsewhere = ~F.col("board_id").eqNullSafe(F.lit(board_id))
    off = F.lit(mode == "off")
    outcome = (
        F.when(off, F.lit("disabled"))
        .when(elsewhere, F.lit("excluded"))
        .when(missing | F.col(trigger).isNull(), F.lit("ignored"))
        .otherwise(F.col("_outcome"))
    )
    reason = (
        F.when(off, F.lit("design_processing_off"))
        .when(elsewhere, F.lit("board_not_managed"))
        .when(missing, F.lit("missing_item_id"))
        .when(F.col(trigger).isNull(), F.lit("event_not_actionable"))
        .otherwise(F.coalesce("_readiness", "_outcome"))
    )
    status = F.when(outcome.isNull(), F.lit("failed")).otherwise("succeeded")
    return df.select("event_id", F.lit("design_processing").alias("consumer"), status.alias("status"), outcome.alias("outcome"), reason.alias("reason"))
