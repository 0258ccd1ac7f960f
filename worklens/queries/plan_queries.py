"""Queries over the plan tables of sync tasks and design processing."""

from __future__ import annotations

from pyspark.sql import functions as F

from worklens import vocab
from worklens.operators import metrics, quality
from worklens.plans import design, lifecycle, policy as rules
from worklens.queries import plan_tables as t
from worklens.queries.base import REGISTRY, Proxy, query, sql_stamp, stamp, table
from worklens.queries.change_events import DISPATCHES
from worklens.session import new_shared_path
from worklens.sources import items as item_source

SYNC_ACTIVE = "('pending', 'scheduled', 'running', 'retry_wait')"
DESIGN_ACTIVE = "('scheduled', 'running', 'retry_wait')"
N = t.NOW


def now():
    return F.expr(t.NOW)


@query(
    "group_scan",
    f"select item_id, group_id, source_pos from {t.ITEMS.sql} where group_id in ('g0', 'g1') order by group_id, source_pos limit 100",
)
def group_scan(spark, sf):
    chosen = item_source.select_from_groups(t.ITEMS.df(spark, sf), ["g0", "g1"], 100)
    return chosen.select("item_id", "group_id", "source_pos")


@query(
    "policy_classification",
    f"""
    select item_id, {t.DECISION['state']} as lifecycle_state, {t.DECISION['reason']} as reason,
      board_id = 'b1' and group_id in ('g0', 'g1', 'g2', 'g3') as should_track, board_id = 'b1' and group_id in ('g0', 'g1') as should_queue,
      board_id = 'b1' and group_id = 'g2' as should_cancel, board_id = 'b1' and group_id = 'g3' as requires_index from {t.ITEMS.sql}
    """,
)
def policy_classification(spark, sf):
    df = t.ITEMS.df(spark, sf)
    return df.select("item_id", rules.classify(t.POLICY, "board_id", "group_id").alias("d")).select("item_id", "d.*")


_READY = """case when item_state <> 'active' or {b} <> 'b1' or {g} <> 'g0' then 'ineligible' when missing_name then 'waiting_for_name'
    when missing_email then 'waiting_for_email' else 'ready' end"""


@query("target_readiness", f"select item_id, {_READY.format(b='board_id', g='group_id')} as readiness from {t.DESIGN_SNAPSHOTS.sql}")
def target_readiness(spark, sf):
    return t.DESIGN_SNAPSHOTS.df(spark, sf).select("item_id", rules.target_readiness("b1", "g0").alias("readiness"))


_LISTED = Proxy("supplier", {"item_id": "cast(s_suppkey as string)"})


@query(
    "mode_gate",
    f"""
    with j as (select j.id, coalesce(execution_kind, 'analysis') as kind, a.item_id is not null as listed
      from {t.DESIGN_JOBS.sql} j left join {_LISTED.sql} a using (item_id))
    select id, kind = 'analysis' as off_is_false, kind = 'analysis' as shadow_allowed, kind = 'analysis' or listed as allowlist_allowed, true as enabled_allowed from j
    """,
)
def mode_gate(spark, sf):
    jobs = rules.with_allowlist(t.DESIGN_JOBS.df(spark, sf), _LISTED.df(spark, sf))
    kind = F.coalesce("execution_kind", F.lit("analysis"))
    return jobs.select(
        "id",
        (~rules.execution_allowed("off", kind, "listed") & (kind == "analysis")).alias("off_is_false"),
        rules.execution_allowed("shadow", kind, "listed").alias("shadow_allowed"),
        rules.execution_allowed("allowlist", kind, "listed").alias("allowlist_allowed"),
        rules.execution_allowed("enabled", kind, "listed").alias("enabled_allowed"),
    )


PROJECTS = Proxy(
    "orders",
    {
        "item_id": "cast(o_orderkey as string)",
        "project_reference": "concat('TP', cast(o_orderkey as string))",
        "project_title": "case when o_custkey % 5 = 0 then '' when o_custkey % 5 = 1 then cast(null as string) else o_orderpriority end",
        "state": "case when o_orderstatus = 'O' then 'active' else 'archived' end",
        "created_date": "substring(cast(o_orderdate as string), 1, 10)",
    },
)


@query(
    "active_projects_since",
    f"select item_id, project_reference, coalesce(nullif(project_title, ''), project_reference) as project_title, created_date from {PROJECTS.sql} where created_date >= '1998-01-01' and state = 'active'",
)
def active_projects_since(spark, sf):
    rows = item_source.since(PROJECTS.df(spark, sf), "1998-01-01")
    return rows.select("item_id", "project_reference", "project_title", "created_date")


@query(
    "readiness_alerts",
    f"""
    select id, round(greatest(0, epoch_us({N}) - epoch_us(created_at)) / 1e6, 3) as readiness_age_seconds from {t.DESIGN_JOBS.sql}
    where status in {DESIGN_ACTIVE} and execution_kind is null and stage in ('waiting_for_name', 'waiting_for_email')
      and greatest(0, epoch_us({N}) - epoch_us(created_at)) / 1e6 >= 21600
    """,
)
def readiness_alerts(spark, sf):
    return metrics.readiness_alerts(t.DESIGN_JOBS.df(spark, sf), now()).select("id", "readiness_age_seconds")


_ANALYSIS_OPEN = """(execution_kind = 'analysis' or (execution_kind is null and
    (d_r is null or a_r is null or a_r <> d_r or a_v <> d_v)))"""


@query(
    "analysis_or_readiness_jobs",
    f"select j.id from {t.DESIGN_JOBS.sql} j join {t.DESIGN_ITEMS.sql} i using (board_id, item_id) where {_ANALYSIS_OPEN}",
)
def analysis_or_readiness_jobs(spark, sf):
    return design.analysis_or_readiness(t.design_items(spark, sf), t.design_jobs(spark, sf)).select("id")


@query(
    "user_visible_tasks",
    f"select external_task_key from {t.TASKS.whole.sql} where account_id in (select distinct 'a' || (c_custkey % 4) from customer where c_nationkey = 3)",
)
def user_visible_tasks(spark, sf):
    links = table(spark, sf, "customer").selectExpr(
        "cast(c_nationkey as string) as user_id", "concat('a', cast(c_custkey % 4 as string)) as account_id"
    )
    return lifecycle.visible_tasks(t.TASKS.whole.df(spark, sf), links, "3").select("external_task_key")


_LATEST = f"""
    with r as (select *, row_number() over (partition by external_task_key order by created_at desc, id desc) as rn from {t.SNAPSHOTS.sql} where ingestion_status = 'complete')
    select external_task_key, id, snapshot_version from r where rn = 1
    """


@query("latest_complete_snapshot", _LATEST)
def latest_complete_snapshot(spark, sf):
    return lifecycle.latest_complete(t.SNAPSHOTS.df(spark, sf)).select("external_task_key", "id", "snapshot_version")


@query(
    "snapshot_keepers",
    f"""
    with r as (select id, first_value(id) over w as keeper_id, row_number() over w as rn from {t.SNAPSHOTS.sql}
      window w as (partition by external_task_key, snapshot_version order by created_at desc, id desc))
    select id as duplicate_id, keeper_id from r where rn > 1
    """,
)
def snapshot_keepers(spark, sf):
    return lifecycle.snapshot_keepers(t.SNAPSHOTS.df(spark, sf))


_OF_ORDERS = Proxy(
    "orders",
    {
        "id": "cast(o_orderkey as string)",
        "external_task_key": "cast(o_custkey as string)",
        "snapshot_version": "o_orderstatus",
        "created_at": t.O_TIME,
    },
)
_OF_LINES = Proxy(
    "lineitem",
    {
        "id": t.SYNC_JOBS.columns["id"],
        "snapshot_id": "cast(l_orderkey as string)",
        "asset_id": "cast(l_partkey % 20 as string)",
        "size_bytes": "cast(l_quantity as bigint)",
    },
)


@query(
    "snapshot_deduplication",
    f"""
    with s as (select *, first_value(id) over w as keeper from {_OF_ORDERS.sql} window w as (partition by external_task_key, snapshot_version order by created_at desc, id desc)),
    f as (select l.*, s.external_task_key, s.keeper, s.created_at from {_OF_LINES.sql} l join s on s.id = l.snapshot_id),
    k as (select distinct keeper, asset_id from f where snapshot_id = keeper),
    r as (select f.*, row_number() over (partition by f.keeper, f.asset_id, f.snapshot_id = f.keeper order by created_at desc, snapshot_id desc, f.id) as rn,
        k.asset_id is not null as held from f left join k on k.keeper = f.keeper and k.asset_id = f.asset_id)
    select id, keeper as snapshot_id, asset_id from r where snapshot_id = keeper or (not held and rn = 1)
    """,
)
def snapshot_deduplication(spark, sf):
    snapshots = _OF_ORDERS.df(spark, sf)
    owner = snapshots.select(F.col("id").alias("snapshot_id"), "external_task_key")
    files = _OF_LINES.df(spark, sf).join(owner, "snapshot_id")
    chunks = files.select(F.col("id").alias("file_id"))
    _, moved, _ = lifecycle.deduplicate_snapshots(snapshots, files, chunks)
    return moved.select("id", "snapshot_id", "asset_id")


def _pick(jobs: str, active: str) -> str:
    return f"""(select * from (select *, row_number() over (partition by board_id, item_id order by created_at, id) as rn
      from {jobs} where status in {active}) where rn = 1)"""


@query("active_job_pick", f"select board_id, item_id, id from {_pick(t.SYNC_JOBS.sql, SYNC_ACTIVE)}")
def active_job_pick(spark, sf):
    return design.pick_active_job(t.SYNC_JOBS.df(spark, sf), vocab.ACTIVE_SYNC_JOB_STATUSES).select("board_id", "item_id", "id")


@query(
    "due_sync_jobs",
    f"""
    select id, status from {t.SYNC_JOBS.sql} where (status in ('pending', 'scheduled') and scheduled_for <= {N})
      or (status = 'retry_wait' and (next_retry_at is null or next_retry_at <= {N})) order by scheduled_for, created_at, id limit 50
    """,
)
def due_sync_jobs(spark, sf):
    jobs = design.due_jobs(t.SYNC_JOBS.df(spark, sf), now(), 50, ("pending", "scheduled"))
    return jobs.select("id", "status")


_SYNC_EXPIRED = f"status = 'running' and (locked_at is null or heartbeat_at <= {N} - interval 1 hour or locked_at <= {N} - interval 1 hour)"
_DESIGN_EXPIRED = f"status = 'running' and (locked_at is null or heartbeat_at <= {N} - interval 1 hour or (heartbeat_at is null and locked_at <= {N} - interval 1 hour))"


@query("expired_sync_leases", f"select id from {t.SYNC_JOBS.sql} where {_SYNC_EXPIRED}")
def expired_sync_leases(spark, sf):
    return design.expired_leases(t.SYNC_JOBS.df(spark, sf), now(), "sync").select("id")


@query("expired_design_leases", f"select id from {t.DESIGN_JOBS.sql} where {_DESIGN_EXPIRED}")
def expired_design_leases(spark, sf):
    return design.expired_leases(t.DESIGN_JOBS.df(spark, sf), now(), "design").select("id")


@query(
    "backfill_plan",
    f"""
    select i.item_id, i.group_id, i.external_task_key, i.source_revision, {t.DECISION['reason'].replace('board_id', 'i.board_id')} as reason,
      case when not coalesce(i.board_id = 'b1' and group_id in ('g0', 'g1', 'g2', 'g3'), false) then 'ignored' when group_id not in ('g0', 'g1') then 'skipped'
        when k.last_indexed_source_revision = i.source_revision then 'fresh' else 'would_queue' end as action
    from {t.ITEMS.sql} i left join {t.TASKS.sql} k using (external_task_key)
    """,
)
def backfill_plan(spark, sf):
    return lifecycle.backfill_plan(t.ITEMS.df(spark, sf), t.TASKS.df(spark, sf), t.POLICY)


_INDEXED = "(coalesce(i.source_revision = k.last_indexed_source_revision, false) or coalesce(i.source_revision = k.latest_snapshot_version, false))"
_RECON = f"""
    with a as (select distinct board_id, item_id, true as active from {t.SYNC_JOBS.sql} where status in {SYNC_ACTIVE}),
    j as (select i.item_id, i.group_id, i.external_task_key, i.board_id, i.source_revision, k.external_task_key as k, k.auto_sync_state, coalesce(k.sync_status, '') as st,
      coalesce(a.active, false) as active, {_INDEXED} as indexed, case when k.sync_status = 'syncing' then k.sync_started_at else k.sync_requested_at end as since
      from {t.ITEMS.sql} i left join {t.TASKS.sql} k using (external_task_key) left join a on a.board_id = i.board_id and a.item_id = i.item_id),
    r as (select *, {t.DECISION['reason']} as reason, case when k is null then 'missing' when auto_sync_state = 'expired' then 'restore' when st = 'failed' then 'failed'
        when st in ('queued', 'syncing') and (not active or since is null or since <= {N} - interval 1 hour) then 'stuck'
        when st in ('queued', 'syncing') then 'already_queued' when not indexed or st <> 'completed' then 'stale' else 'fresh' end as sync_reason from j),
    q as (select *, board_id = 'b1' and group_id in ('g0', 'g1') and sync_reason in ('missing', 'restore', 'failed', 'stuck', 'stale') as queue from r)
    select item_id, group_id, external_task_key, sync_reason, queue, case when queue then 'would_queue_' || sync_reason else sync_reason end as action, reason,
      case when queue and not (sync_reason in ('failed', 'stuck') and indexed) then source_revision end as job_revision from q
    """


def _reconciliation(spark, sf):
    return lifecycle.reconciliation_plan(
        t.ITEMS.df(spark, sf), t.TASKS.df(spark, sf), t.SYNC_JOBS.df(spark, sf), t.POLICY, now=now()
    )


@query("reconciliation_plan", _RECON)
def reconciliation_plan(spark, sf):
    return _reconciliation(spark, sf)


@query(
    "reconciliation_summary",
    f"select reason, count(*) as scanned, count_if(queue) as queued, count_if(not queue) as skipped, 0::bigint as errors from ({_RECON}) group by 1".replace(
        "count_if(queue)", "count(*) filter (queue)"
    ).replace("count_if(not queue)", "count(*) filter (not queue)"),
)
def reconciliation_summary(spark, sf):
    return lifecycle.run_summary(_reconciliation(spark, sf), F.col("queue"), "reason")


#: Reasons that a policy can give.
REASONS = ("board_not_managed", "excluded_group", "active_group", "auto_sync_disabled", "completed_retention_only", "unknown_group")


@query("observed_summary", REGISTRY["reconciliation_summary"][1])
def observed_summary(spark, sf):
    """The same counts, observed while the plan is written."""
    path = new_shared_path(spark, "reconciliation")
    return lifecycle.write_with_summary(_reconciliation(spark, sf), path, F.col("queue"), "reason", REASONS)


@query(
    "transition_plan",
    f"""
    select k.item_id, k.external_task_key, i.group_id, {t.DECISION['reason'].replace('board_id', 'i.board_id').replace('group_id', 'i.group_id')} as reason,
      case when i.group_id = 'g3' then 'would_mark_completed_retained' when i.group_id = 'g2' then 'would_mark_excluded' when i.group_id in ('g0', 'g1') then 'still_active' else 'ignored' end as action
    from {t.TASKS.whole.sql} k join {t.ITEMS.sql} i using (item_id)
    where k.board_id = 'b1' and auto_sync_state = 'active' and sync_status = 'completed' and (last_indexed_source_revision is not null or latest_snapshot_version is not null)
    """,
)
def transition_plan(spark, sf):
    return lifecycle.transition_plan(t.TASKS.whole.df(spark, sf), t.ITEMS.df(spark, sf), t.POLICY)


_POLICY_PLAN = f"""
    with j as (select i.*, k.external_task_key is not null as known, k.completed_at, k.purge_after, k.last_indexed_source_revision as ix, f.id as job, f.status as js, f.desired_source_revision as jr,
        {t.DECISION['state'].replace('board_id', 'i.board_id').replace('group_id', 'i.group_id')} as state, {t.DECISION['reason'].replace('board_id', 'i.board_id').replace('group_id', 'i.group_id')} as reason
      from {t.ITEMS.sql} i left join {t.TASKS.sql} k using (external_task_key) left join {_pick(t.SYNC_JOBS.sql, SYNC_ACTIVE)} f on f.board_id = i.board_id and f.item_id = i.item_id),
    a as (select *, case when state is null or (state = 'completed_retained' and not known) then 'none' when state = 'completed_retained' then 'retain' when known then 'update' else 'create' end as task_action from j),
    b as (select *, case when state is distinct from 'active' then 'none' when ix = desired_source_revision then 'skipped' when job is null then 'create' when js = 'running' then 'retarget_running' else 'coalesce' end as job_action from a)
    select board_id, item_id, external_task_key, task_action, case when task_action <> 'none' then state end as lifecycle_state,
      {sql_stamp(f"case when task_action = 'retain' then coalesce(completed_at, {N}) when state <> 'active' then completed_at end")} as completed_at,
      {sql_stamp(f"case when task_action = 'retain' then coalesce(completed_at, {N}) + interval 30 days when state <> 'active' then purge_after end")} as purge_after,
      job_action, case when job_action <> 'create' then job end as job_id, case when job_action in ('create', 'coalesce', 'retarget_running') then 'webhook' end as trigger_type,
      case when job_action in ('create', 'coalesce', 'retarget_running') then coalesce(desired_source_revision, jr) end as job_revision,
      {sql_stamp(f"case when job_action in ('create', 'coalesce') then {N} + interval 90 seconds end")} as scheduled_for,
      coalesce(state = 'excluded' and job is not null, false) as cancel_jobs, reason from b
    """


def _policy_plan(spark, sf):
    return lifecycle.policy_plan(
        t.ITEMS.df(spark, sf), t.TASKS.df(spark, sf), t.SYNC_JOBS.df(spark, sf), t.POLICY, now=now(), trigger_type="webhook"
    )


@query("policy_plan", _POLICY_PLAN)
def policy_plan(spark, sf):
    plan = _policy_plan(spark, sf)
    for name in ("completed_at", "purge_after", "scheduled_for"):
        plan = plan.withColumn(name, stamp(name))
    return plan


@query(
    "jobs_to_cancel",
    f"""
    select j.id, j.board_id, j.item_id, 'cancelled' as status, 'excluded_group' as last_error from {t.SYNC_JOBS.sql} j join {t.ITEMS.sql} i using (item_id)
    where i.board_id = 'b1' and i.group_id = 'g2' and j.status in {SYNC_ACTIVE}
    """,
)
def jobs_to_cancel(spark, sf):
    return lifecycle.jobs_to_cancel(_policy_plan(spark, sf), t.SYNC_JOBS.df(spark, sf))


@query(
    "task_status",
    f"""
    with l as (select *, row_number() over (partition by external_task_key order by changed_at desc, id desc) as rn from {t.SYNC_JOBS.sql}),
    j as (select l.*, k.last_indexed_source_revision as ix from l join {t.TASKS.whole.sql} k using (external_task_key) where rn = 1)
    select external_task_key, case when status in ('pending', 'scheduled') then 'queued' when status = 'running' then 'syncing' when status in ('completed', 'skipped') then 'completed'
        when status in ('failed', 'retry_wait') then 'failed' end as sync_status,
      case when status = 'skipped' then 'skipped' when status = 'completed' then result when status in ('failed', 'retry_wait') then 'failed' end as last_sync_result,
      {sql_stamp("case when status in ('completed', 'skipped', 'failed', 'retry_wait') then changed_at end")} as sync_finished_at,
      case when status in ('failed', 'retry_wait') then last_error end as sync_error, trigger_type as last_sync_trigger,
      case when status in ('completed', 'skipped') then coalesce(desired_source_revision, ix) else ix end as last_indexed_source_revision from j
    """,
)
def task_status(spark, sf):
    rows = lifecycle.task_status(t.TASKS.whole.df(spark, sf), t.SYNC_JOBS.df(spark, sf))
    return rows.withColumn("sync_finished_at", stamp("sync_finished_at"))


_DUE = f"""select * from {t.TASKS.whole.sql} where board_id = 'b1' and auto_sync_state in ('completed_retained', 'purge_pending', 'storage_deleting', 'database_cleaning')
    and retention_hold is not true and purge_after <= {N}"""


def _due(spark, sf):
    return lifecycle.due_for_purge(t.TASKS.whole.df(spark, sf), "b1", now())


@query("purge_scan", f"select external_task_key from ({_DUE}) order by purge_after, updated_at, external_task_key limit 25")
def purge_scan(spark, sf):
    return lifecycle.due_for_purge(t.TASKS.whole.df(spark, sf), "b1", now(), limit=25).select("external_task_key")


_MANIFEST = f"select f.id, f.external_task_key, f.bucket, f.object_path from {t.FILES.sql} f join ({_DUE}) d using (external_task_key) where f.deleted_at is null and f.storage_status = 'stored'"


@query("purge_manifest", _MANIFEST)
def purge_manifest(spark, sf):
    return lifecycle.delete_manifest(_due(spark, sf), t.FILES.df(spark, sf)).drop("created_at")


RESULTS = Proxy(
    "lineitem",
    {"id": t.SYNC_JOBS.columns["id"], "error": f"case when l_tax > 0.07 and l_discount > 0.05 then 'denied' else {t.NULL_TEXT} end"},
    # Objects without a delete result count as failed.
    where="l_returnflag <> 'R' or l_quantity > 5",
)
_OUTCOME = f"""
    with c as (select m.external_task_key, count(*) filter (r.id is not null and r.error is null) as ok, count(*) filter (r.id is null or r.error is not null) as bad
      from ({_MANIFEST}) m left join {RESULTS.sql} r on r.id = m.id group by 1)
    select d.external_task_key, coalesce(ok, 0) as files_deleted, coalesce(bad, 0) as files_failed, case when coalesce(bad, 0) > 0 then 'storage_failed' else 'expired' end as action,
      case when coalesce(bad, 0) > 0 then 'storage_deleting' else 'expired' end as auto_sync_state,
      case when bad > 0 then 'Purge failed to delete ' || bad || ' Storage object(s)' end as sync_error
    from ({_DUE}) d left join c using (external_task_key)
    """


def _purge_outcome(spark, sf):
    due = _due(spark, sf)
    return lifecycle.purge_outcome(due, lifecycle.delete_manifest(due, t.FILES.df(spark, sf)), RESULTS.df(spark, sf))


@query("purge_outcome", _OUTCOME)
def purge_outcome(spark, sf):
    return _purge_outcome(spark, sf)


@query(
    "purge_tombstones",
    f"""
    with o as ({_OUTCOME})
    select k.external_task_key, coalesce(o.auto_sync_state, k.auto_sync_state) as auto_sync_state, case when o.external_task_key is null then k.sync_error else o.sync_error end as sync_error,
      case when o.action = 'expired' then null else k.latest_snapshot_version end as latest_snapshot_version, k.last_indexed_source_revision,
      case when o.action = 'expired' then 'completed' else k.sync_status end as sync_status, case when o.action = 'expired' then 'skipped' else k.last_sync_result end as last_sync_result,
      {sql_stamp(f"case when o.action = 'expired' then {N} end")} as raw_purged_at
    from {t.TASKS.whole.sql} k left join o using (external_task_key)
    """,
)
def purge_tombstones(spark, sf):
    rows = lifecycle.tombstones(t.TASKS.whole.df(spark, sf), _purge_outcome(spark, sf), now())
    return rows.select(
        "external_task_key",
        "auto_sync_state",
        "sync_error",
        "latest_snapshot_version",
        "last_indexed_source_revision",
        "sync_status",
        "last_sync_result",
        stamp("raw_purged_at").alias("raw_purged_at"),
    )


@query(
    "purge_rows_kept",
    f"select f.id from {t.FILES.sql} f where external_task_key not in (select external_task_key from ({_OUTCOME}) where action = 'expired')",
)
def purge_rows_kept(spark, sf):
    files = t.FILES.df(spark, sf)
    return lifecycle.rows_kept(files, _purge_outcome(spark, sf)).select("id")


ACCESS = Proxy(
    "lineitem",
    {
        "external_task_key": t.L_KEY,
        "accessed_at": f"{t.L_TIME} + interval '1' second * l_partkey",
        "kind": "case l_suppkey % 8 when 0 then 'hold' when 1 then 'release' when 2 then 'restore' else 'access' end",
    },
)


@query(
    "retention_clock",
    f"""
    with a as (select external_task_key, max(accessed_at) filter (kind <> 'release') as t, max(accessed_at) filter (kind = 'restore') as r,
        arg_max(kind, accessed_at) filter (kind in ('hold', 'release')) as h, count(distinct accessed_at) filter (kind in ('hold', 'release')) as n from {ACCESS.sql} group by 1),
    j as (select k.*, a.t, a.r, case a.h when 'hold' then true when 'release' then false else k.retention_hold end as hold, auto_sync_state = 'expired' and a.r is not null as restored
      from {t.TASKS.whole.sql} k left join a using (external_task_key)),
    s as (select *, case when restored then 'completed_retained' else auto_sync_state end as state from j)
    select external_task_key, state as auto_sync_state, hold as retention_hold, {sql_stamp('case when restored then coalesce(completed_at, r) else completed_at end')} as completed_at,
      {sql_stamp("case when restored then r + interval 30 days when state = 'completed_retained' and t is not null and hold is not true then t + interval 30 days else purge_after end")} as purge_after,
      {sql_stamp('t')} as last_meaningful_access_at from s
    """,
)
def retention_clock(spark, sf):
    rows = lifecycle.retention_clock(t.TASKS.whole.df(spark, sf), ACCESS.df(spark, sf), t.POLICY)
    for name in ("completed_at", "purge_after", "last_meaningful_access_at"):
        rows = rows.withColumn(name, stamp(name))
    return rows


_FRESH = f"""
    with c as (select distinct external_task_key, snapshot_version as source_revision from {t.SNAPSHOTS.sql} where ingestion_status = 'complete'),
    j as (select k.*, i.source_revision, c.external_task_key is not null as done from {t.TASKS.sql} k left join {t.ITEMS.sql} i using (external_task_key)
      left join c on c.external_task_key = k.external_task_key and c.source_revision = i.source_revision),
    f as (select *, coalesce(sync_status = 'completed', false) and auto_sync_state <> 'expired' and (coalesce(source_revision = last_indexed_source_revision, false)
      or coalesce(source_revision = latest_snapshot_version, false)) and done as fresh from j)
    select external_task_key, fresh, not fresh and coalesce(sync_status, '') not in ('queued', 'syncing') as refresh_due from f
    """


@query("task_freshness", _FRESH)
def task_freshness(spark, sf):
    return lifecycle.freshness(t.TASKS.df(spark, sf), t.SNAPSHOTS.df(spark, sf), t.ITEMS.df(spark, sf))


@query(
    "incremental_skip",
    f"""
    select i.external_task_key, i.source_revision from {t.ITEMS.sql} i where not exists
      (select 1 from {t.SNAPSHOTS.sql} s where s.ingestion_status = 'complete' and s.external_task_key = i.external_task_key and s.snapshot_version = i.source_revision)
    """,
)
def incremental_skip(spark, sf):
    wanted = t.ITEMS.df(spark, sf).select("external_task_key", "source_revision")
    return lifecycle.needs_ingest(wanted, t.SNAPSHOTS.df(spark, sf))


@query(
    "task_sources",
    f"""
    with l as (select external_task_key, arg_max(l_suppkey::varchar, (created_at, id)) as snapshot_id, arg_max(snapshot_version, (created_at, id)) as snapshot_version
      from (select *, l_suppkey from (select {", ".join(f"{e} as {n}" for n, e in t.SNAPSHOTS.columns.items())}, l_suppkey from lineitem)) where ingestion_status = 'complete' group by 1)
    select f.id, f.external_task_key, l.snapshot_version, f.storage_status = 'stored' as download_available from {t.FILES.sql} f join l using (external_task_key, snapshot_id)
    """,
)
def task_sources(spark, sf):
    columns = {**t.SNAPSHOTS.columns, "key": t.SNAPSHOTS.columns["id"], "snapshot": "cast(l_suppkey as string)"}
    latest = lifecycle.latest_complete(Proxy("lineitem", columns).df(spark, sf))
    snapshots = latest.drop("id").withColumnRenamed("snapshot", "id")
    rows = lifecycle.task_sources(snapshots, t.FILES.df(spark, sf))
    return rows.select("id", "external_task_key", "snapshot_version", "download_available")


@query(
    "task_summary",
    f"with l as ({_LATEST}) select k.external_task_key, l.snapshot_version, k.sync_status, k.sync_error from {t.TASKS.whole.sql} k left join l using (external_task_key)",
)
def task_summary(spark, sf):
    rows = lifecycle.task_summary(t.TASKS.whole.df(spark, sf), t.SNAPSHOTS.df(spark, sf))
    return rows.select("external_task_key", "snapshot_version", "sync_status", "sync_error")


# ---- design processing -------------------------------------------------------

_OBLIGATION = """case when d_r is not null and ((d_r, d_v) is distinct from (a_r, a_v)) then 'analysis'
    when {allowed} and d_r is not null and ((d_r, d_v) is distinct from (p_r, p_v)) then 'publication' end"""


@query("design_obligations", f"select board_id, item_id, {_OBLIGATION.format(allowed='true')} as obligation from {t.DESIGN_ITEMS.whole.sql}")
def design_obligations(spark, sf):
    return design.obligations(t.design_items(spark, sf, whole=True), "enabled").select("board_id", "item_id", "obligation")


_QUEUE = f"""
    with a as ({_pick(t.DESIGN_JOBS.sql, DESIGN_ACTIVE)}),
    j as (select s.*, i.item_id is not null as known, i.state as st, i.d_r as b_r, i.d_v as b_v, i.a_r, i.a_v, i.p_r, i.p_v, a.id as job, a.status as js, a.execution_kind as jk, a.e_r, a.e_v,
        {_READY.format(b='s.board_id', g='s.group_id')} as readiness, l.item_id is not null as allowed
      from {t.DESIGN_SNAPSHOTS.sql} s left join (select * from {t.DESIGN_ITEMS.sql} where board_id = 'b1') i using (item_id)
      left join (select * from a where board_id = 'b1') a using (item_id) left join {_LISTED.sql} l using (item_id)),
    d as (select *, case when readiness = 'ready' then input_revision end as d_r, case when readiness = 'ready' then 'p1' end as d_v, board_id <> 'b1' or group_id <> 'g0' as elsewhere from j),
    o as (select *, readiness in ('waiting_for_name', 'waiting_for_email') or ({_OBLIGATION.format(allowed='allowed')}) is not null as req,
        coalesce(js = 'running', false) as running, coalesce(js <> 'running' and e_r is not null and ((e_r, e_v) is distinct from (d_r, d_v) or (jk = 'publication' and not allowed)), false) as replaced,
        (b_r, b_v) is distinct from (d_r, d_v) as changed from d),
    r as (select *, case when elsewhere then 'excluded' when running then 'coalesced' when job is not null and not replaced then 'coalesced' when job is not null and req then 'coalesced'
        when req then 'queued' else 'ignored' end as outcome from o)
    select item_id, outcome, readiness, case when not elsewhere then d_r end as desired_revision,
      case when elsewhere then known and job is not null else not running and replaced end as cancel_job,
      not elsewhere and not running and req and (job is null or replaced) as create_job,
      running and e_r is not null and changed and (e_r, e_v) is distinct from (d_r, d_v) as request_supersession,
      case when elsewhere then case when known then 'ineligible' end
        when outcome = 'ignored' and d_r is not null and (a_r, a_v) is not distinct from (d_r, d_v) and (p_r, p_v) is distinct from (d_r, d_v) then 'analyzed'
        when replaced and readiness = 'ready' then 'scheduled'
        when readiness <> 'ready' then readiness
        when changed and d_r is not null and (d_r, d_v) is distinct from (p_r, p_v) and running then case when jk = 'publication' then 'publishing' else 'processing' end
        when changed and d_r is not null and (d_r, d_v) is distinct from (p_r, p_v) then 'scheduled'
        when changed and coalesce(st, 'scheduled') in ('waiting_for_name', 'waiting_for_email', 'ineligible', 'failed') then 'scheduled'
        else coalesce(st, 'scheduled') end as item_state from r
    """
_SETTINGS = dict(mode="allowlist", pipeline_version="p1", board_id="b1", group_id="g0")


@query("design_queue_plan", _QUEUE)
def design_queue_plan(spark, sf):
    plan = design.queue_plan(
        t.DESIGN_SNAPSHOTS.df(spark, sf), t.design_items(spark, sf), t.design_jobs(spark, sf), allowlist=_LISTED.df(spark, sf), **_SETTINGS
    )
    return plan.withColumn("desired", F.col("desired.input_revision")).withColumnRenamed("desired", "desired_revision")


@query(
    "landing_reconciliation",
    f"""
    with q as ({_QUEUE}), c as (select item_id, created_at >= timestamp '1998-01-01 00:00:00' as late from {t.DESIGN_SNAPSHOTS.sql})
    select item_id, 'skipped' as action, 'before_activation_timestamp' as reason from c where not late
    union all select q.item_id, 'would_' || outcome, readiness from q join c using (item_id) where late
    """,
)
def landing_reconciliation(spark, sf):
    snapshots = t.DESIGN_SNAPSHOTS.df(spark, sf)
    return design.landing_plan(
        snapshots.select("item_id", "created_at", "source_pos"),
        snapshots,
        t.design_items(spark, sf),
        t.design_jobs(spark, sf),
        activation=F.expr("timestamp '1998-01-01 00:00:00'"),
        allowlist=_LISTED.df(spark, sf),
        **_SETTINGS,
    )


@query(
    "landing_summary",
    f"""
    with q as ({_QUEUE}), c as (select item_id, created_at >= timestamp '1998-01-01 00:00:00' as late from {t.DESIGN_SNAPSHOTS.sql})
    select case when late then 'would_' || outcome else 'skipped' end as action, count(*) as n from q join c using (item_id) group by 1
    """,
)
def landing_summary(spark, sf):
    return lifecycle.action_counts(landing_reconciliation(spark, sf))


@query(
    "design_lease_recovery",
    f"""
    with j as (select j.*, i.state as st, i.d_r, i.d_v, coalesce(execution_kind, 'analysis') as kind, l.item_id is not null as listed
      from (select * from {t.DESIGN_JOBS.sql} where {_DESIGN_EXPIRED}) j join {t.DESIGN_ITEMS.sql} i using (board_id, item_id) left join {_LISTED.sql} l using (item_id)),
    a as (select *, case when kind = 'publication' and not listed then 'cancel' when e_r is not null and (e_r, e_v) is distinct from (d_r, d_v) then 'replace' when e_r is null then 'reschedule'
        when attempt_count >= max_attempts then 'fail' else 'retry' end as action, st in ('waiting_for_name', 'waiting_for_email') as waiting from j)
    select id, board_id, item_id, action, case when action = 'cancel' then 'analyzed' when action = 'replace' and waiting then st when action = 'replace' and d_r is null then 'waiting_for_email'
      when action = 'replace' then 'scheduled' when action = 'fail' then 'failed' when action = 'retry' then case when kind = 'analysis' then 'processing' else 'publishing' end else st end as item_state from a
    """,
)
def design_lease_recovery(spark, sf):
    return design.lease_recovery_plan(
        t.design_jobs(spark, sf), t.design_items(spark, sf), now=now(), mode="allowlist", allowlist=_LISTED.df(spark, sf), limit=None
    )


@query(
    "sync_lease_recovery",
    f"""
    select id, board_id, item_id, case when attempt_count >= 3 then 'failed' else 'retry_wait' end as next_status,
      {sql_stamp(f"case when attempt_count < 3 then {N} end")} as next_retry_at, 'Worker lease expired' as last_error from {t.SYNC_JOBS.sql} where {_SYNC_EXPIRED}
    """,
)
def sync_lease_recovery(spark, sf):
    plan = design.sync_lease_recovery_plan(t.SYNC_JOBS.df(spark, sf), now=now())
    return plan.withColumn("next_retry_at", stamp("next_retry_at"))


def _failure_sql(source: str, counted: str) -> str:
    return f"""
    with j as (select id, board_id, item_id, {counted} as n from {source})
    select id, board_id, item_id, n as attempt_count, case when n >= 3 then 'failed' else 'retry_wait' end as next_status,
      {sql_stamp(f"case when n < 3 then {N} + interval 1 second * least(3600, 60 * pow(2, greatest(n - 1, 0)))::int end")} as next_retry_at from j
    """


@query("sync_failure_plan", _failure_sql(t.SYNC_JOBS.sql, "attempt_count"))
def sync_failure_plan(spark, sf):
    plan = design.failure_plan(t.SYNC_JOBS.df(spark, sf), now=now(), side="sync")
    return plan.withColumn("next_retry_at", stamp("next_retry_at"))


@query("design_failure_plan", _failure_sql(t.DESIGN_JOBS.sql, "case when e_r is null then attempt_count + 1 else attempt_count end"))
def design_failure_plan(spark, sf):
    plan = design.failure_plan(t.design_jobs(spark, sf), now=now(), side="design")
    return plan.withColumn("next_retry_at", stamp("next_retry_at"))


@query(
    "operator_retry_plan",
    f"""
    with a as (select distinct board_id, item_id from {t.DESIGN_JOBS.sql} where status in {DESIGN_ACTIVE}),
    j as (select j.*, i.d_r, i.d_v, coalesce(execution_kind, 'analysis') as kind, a.item_id is not null as active, l.item_id is not null as listed
      from {t.DESIGN_JOBS.sql} j join {t.DESIGN_ITEMS.sql} i using (board_id, item_id) left join a using (board_id, item_id) left join {_LISTED.sql} l using (item_id)),
    o as (select *, case when active then 'coalesced' when status <> 'failed' then 'refused_not_failed' when e_r is not null and (e_r, e_v) is distinct from (d_r, d_v) then 'refused_superseded'
        when kind = 'publication' and not listed then 'refused_by_mode' else 'scheduled' end as outcome from j)
    select id, board_id, item_id, outcome, case when outcome = 'scheduled' then greatest(max_attempts, attempt_count + 1) else max_attempts end as max_attempts,
      case when outcome = 'scheduled' then case when kind = 'publication' then 'analyzed' else 'scheduled' end end as item_state from o
    """,
)
def operator_retry_plan(spark, sf):
    jobs = t.design_jobs(spark, sf)
    return design.operator_retry_plan(jobs, jobs, t.design_items(spark, sf), mode="allowlist", allowlist=_LISTED.df(spark, sf))


@query(
    "execution_gate",
    f"""
    with j as (select j.*, i.d_r, i.d_v, s.input_revision as rev, {_READY.format(b='s.board_id', g='s.group_id')} as ready, coalesce(execution_kind, 'analysis') as kind, l.item_id is not null as listed
      from {t.DESIGN_JOBS.sql} j join {t.DESIGN_ITEMS.sql} i using (board_id, item_id) join {t.DESIGN_SNAPSHOTS.sql} s using (item_id) left join {_LISTED.sql} l using (item_id)),
    m as (select *, status <> 'running' or locked_by <> 'w1' as lost, kind = 'publication' and not listed as barred, case when ready = 'ready' then rev end as f_r, case when ready = 'ready' then 'p1' end as f_v from j)
    select id, board_id, item_id, case when lost then 'lease_lost' when barred then 'execution_disabled' when e_r is null then 'execution_unassigned' when (d_r, d_v) is distinct from (e_r, e_v) then 'stored_identity_changed'
        when e_v <> 'p1' then 'pipeline_changed' when ready <> 'ready' or rev is null then ready when rev <> e_r then 'input_changed' end as mismatch,
      case when not lost and not barred and e_r is not null and (d_r, d_v) is not distinct from (e_r, e_v) and e_v = 'p1' and ready = 'ready' and rev = e_r then 'run'
        when lost then 'not_claimed' when barred then 'cancel' when ready = 'ineligible' then 'cancel_ineligible' when e_r is null then 'cancel'
        when (e_r, e_v) is not distinct from (f_r, f_v) then case when attempt_count >= max_attempts then 'fail' else 'retry' end else 'replace' end as action from m
    """,
)
def execution_gate(spark, sf):
    return design.execution_gate(
        t.design_jobs(spark, sf),
        t.design_items(spark, sf),
        t.DESIGN_SNAPSHOTS.df(spark, sf),
        worker_id="w1",
        allowlist=_LISTED.df(spark, sf),
        **_SETTINGS,
    )


DESIGN_EVENTS = Proxy(
    "events",
    {
        "event_id": "event_id",
        "board_id": "case when event_id % 11 = 0 then 'b9' else 'b1' end",
        "item_id": "case when event_id % 13 = 0 then '' else cast(user_id as string) end",
        "trigger_type": f"case when event_type = 'view' then {t.NULL_TEXT} else 'webhook_move' end",
    },
)


@query(
    "design_dispatch_outcomes",
    f"""
    with q as ({_QUEUE})
    select e.event_id, 'design_processing' as consumer, 'succeeded' as status,
      case when e.board_id <> 'b1' then 'excluded' when e.item_id = '' or trigger_type is null then 'ignored' else q.outcome end as outcome,
      case when e.board_id <> 'b1' then 'board_not_managed' when e.item_id = '' then 'missing_item_id' when trigger_type is null then 'event_not_actionable' else q.readiness end as reason
    from {DESIGN_EVENTS.sql} e left join q using (item_id)
    """,
)
def design_dispatch_outcomes(spark, sf):
    plan = design.queue_plan(
        t.DESIGN_SNAPSHOTS.df(spark, sf), t.design_items(spark, sf), t.design_jobs(spark, sf), allowlist=_LISTED.df(spark, sf), **_SETTINGS
    )
    return design.dispatch_outcome(DESIGN_EVENTS.df(spark, sf), plan, mode="allowlist", board_id="b1")


_REQUIRED = "(artifact_kind = 'match_report' and column_id = 'file_mm59rntf' or artifact_kind in ('ai_data', 'ai_data_pdf') and column_id = 'file_mkza7y37')"
_COMPLETE = f"""select board_id, item_id, input_revision, pipeline_version from {t.ARTIFACTS.sql}
    where {_REQUIRED} and status = 'published' and asset_id is not null group by all having count(distinct artifact_kind) = 3"""


@query("complete_identities", _COMPLETE)
def complete_identities(spark, sf):
    return design.complete_identities(t.ARTIFACTS.df(spark, sf))


@query(
    "ready_for_review",
    f"""
    select i.board_id, i.item_id from {t.DESIGN_ITEMS.sql} i join ({_COMPLETE}) c on c.board_id = i.board_id and c.item_id = i.item_id and c.input_revision = i.p_r and c.pipeline_version = i.p_v
    where i.d_r is not null and (d_r, d_v) is not distinct from (p_r, p_v)
    """,
)
def ready_for_review(spark, sf):
    return design.ready_for_review(t.design_items(spark, sf), t.ARTIFACTS.df(spark, sf)).select("board_id", "item_id")


@query(
    "artifact_supersession",
    f"""
    select a.id, 'delete_pending' as status from {t.ARTIFACTS.sql} a join {t.DESIGN_ITEMS.sql} i using (board_id, item_id)
    where a.status = 'published' and a.asset_id is not null and i.p_r is not null and (a.input_revision, a.pipeline_version) is distinct from (p_r, p_v)
    """,
)
def artifact_supersession(spark, sf):
    return design.supersede_artifacts(t.ARTIFACTS.df(spark, sf), t.design_items(spark, sf)).select("id", "status")


COLUMN_FILES = Proxy(
    "lineitem",
    {
        "board_id": t.L_BOARD,
        "item_id": "cast(l_orderkey as string)",
        "column_id": t.ARTIFACTS.columns["column_id"],
        "asset_id": "cast(l_partkey as string)",
        "filename": "concat('f', cast(l_partkey % 4 as string))",
        "size_bytes": "case when l_suppkey % 4 = 0 then cast(null as bigint) else cast(l_quantity as bigint) end",
    },
    # Artifacts whose file is gone from its column.
    where="l_returnflag <> 'N'",
)


@query(
    "artifact_cleanup",
    f"""
    with n as (select board_id, item_id, column_id, count(*) as files from {COLUMN_FILES.sql} group by all), h as (select distinct board_id, item_id, column_id, asset_id from {COLUMN_FILES.sql})
    select a.id, a.board_id, a.item_id, case when i.p_r is null or (a.input_revision, a.pipeline_version) is not distinct from (p_r, p_v) then 'cleanup_replacement_missing'
      when c.item_id is null then 'cleanup_replacement_incomplete' when h.asset_id is null then 'already_gone' when n.files <= 1 then 'last_file_kept' else 'delete' end as verdict
    from {t.ARTIFACTS.sql} a join {t.DESIGN_ITEMS.sql} i using (board_id, item_id) left join ({_COMPLETE}) c on c.board_id = a.board_id and c.item_id = a.item_id and c.input_revision = p_r and c.pipeline_version = p_v
    left join n on n.board_id = a.board_id and n.item_id = a.item_id and n.column_id = a.column_id
    left join h on h.board_id = a.board_id and h.item_id = a.item_id and h.column_id = a.column_id and h.asset_id = a.asset_id where a.status = 'delete_pending'
    """,
)
def artifact_cleanup(spark, sf):
    plan = design.cleanup_plan(t.ARTIFACTS.df(spark, sf), t.design_items(spark, sf), COLUMN_FILES.df(spark, sf))
    return plan.select("id", "board_id", "item_id", "verdict")


@query(
    "artifact_adoption",
    f"""
    with c as (select a.id, a.status, a.board_id, a.item_id, count(f.asset_id) as named, count(case when f.size_bytes is null or f.size_bytes = a.size_bytes then f.asset_id end) as fit,
        min(case when f.size_bytes is null or f.size_bytes = a.size_bytes then f.asset_id end) as chosen
      from {t.ARTIFACTS.sql} a left join {COLUMN_FILES.sql} f on f.board_id = a.board_id and f.item_id = a.item_id and f.column_id = a.column_id and f.filename = a.deterministic_filename group by 1, 2, 3, 4)
    select id, board_id, item_id, case when status not in ('uploading', 'failed', 'published') then 'wrong_status' when fit > 1 then 'ambiguous' when named > 0 and fit = 0 then 'wrong_size'
      when fit = 1 then 'adopt' else 'upload' end as verdict, case when status in ('uploading', 'failed', 'published') and fit = 1 then chosen end as asset_id from c
    """,
)
def artifact_adoption(spark, sf):
    return design.adoption_plan(t.ARTIFACTS.df(spark, sf), COLUMN_FILES.df(spark, sf))


@query(
    "stages_to_run",
    f"""
    select distinct board_id, item_id, d_r as input_revision, d_v as pipeline_version from {t.DESIGN_ITEMS.whole.sql} i where d_r is not null and not exists
      (select 1 from {t.ARTIFACTS.sql} a where a.artifact_kind = 'match_report' and a.board_id = i.board_id and a.item_id = i.item_id and a.input_revision = d_r and a.pipeline_version = d_v)
    """,
)
def stages_to_run(spark, sf):
    wanted = t.DESIGN_ITEMS.whole.df(spark, sf).filter("d_r is not null").selectExpr(
        "board_id", "item_id", "d_r as input_revision", "d_v as pipeline_version"
    )
    outputs = t.ARTIFACTS.df(spark, sf).withColumnRenamed("artifact_kind", "stage")
    return design.reusable_stages(wanted, outputs, "match_report")


VALUES = Proxy(
    "orders",
    {
        "item_id": "cast(o_orderkey as string)",
        "date_received": f"case when o_orderkey % 4 = 0 then 'Not found' when o_orderkey % 4 = 1 then 'soon' else substring(cast({t.O_TIME} as string), 1, 10) end",
        "hour_received": "case when o_custkey % 3 = 0 then 'n/a' else concat(cast(o_custkey % 24 as string), ':05') end",
        "post_code": "case o_orderpriority when '1-URGENT' then 'SW' when '2-HIGH' then 'WA' when '3-MEDIUM' then 'Not provided' when '5-LOW' then '' else 'M' end",
    },
)
SETTINGS_JSON = '{"labels": [{"id": 11, "name": "SW"}, {"id": 12, "name": "WA"}]}'
_PAYLOAD = f"""
    with p as (select item_id, case when date_received not in ('Not found', 'soon') then date_received end as d, case when hour_received <> 'n/a' then split_part(hour_received, ':', 1)::int end as h,
      case post_code when 'SW' then 11 when 'WA' then 12 end::bigint as z from {VALUES.sql})
    """


@query(
    "publication_payload",
    f"""{_PAYLOAD} select item_id, d as date, h as hour, case when h is not null then 5 end as minute, z as zip_id,
      concat_ws('|', case when d is null then '{vocab.WARN_DATE}' end, case when h is null then '{vocab.WARN_HOUR}' end, case when z is null then '{vocab.WARN_ZIP}' end) as warnings from p""",
)
def publication_payload(spark, sf):
    rows = design.publication_payload(VALUES.df(spark, sf), SETTINGS_JSON)
    return rows.select(
        "item_id", "date", F.col("hour.hour").alias("hour"), F.col("hour.minute").alias("minute"), "zip_id", F.array_join("warnings", "|").alias("warnings")
    )


@query(
    "column_writes",
    f"""{_PAYLOAD} select item_id, '{vocab.DATE_COLUMN}' as column_id, '{{"date":"' || d || '"}}' as value from p where d is not null
      union all select item_id, '{vocab.HOUR_COLUMN}', '{{"hour":' || h || ',"minute":5}}' from p where h is not null
      union all select item_id, '{vocab.ZIP_COLUMN}', '{{"ids":[' || z || ']}}' from p where z is not null""",
)
def column_writes(spark, sf):
    return design.column_writes(design.publication_payload(VALUES.df(spark, sf), SETTINGS_JSON))


WRITES = Proxy(
    "lineitem",
    {
        "item_id": "cast(l_orderkey as string)",
        "column_id": f"case l_partkey % 3 when 0 then '{vocab.DATE_COLUMN}' when 1 then '{vocab.HOUR_COLUMN}' else 'status' end",
        "value": f"case when l_suppkey % 10 = 0 then '' when l_suppkey % 10 = 1 then {t.NULL_TEXT} else l_returnflag end",
    },
)


@query(
    "owned_column_violations",
    f"""
    select item_id, column_id, value, case when column_id = 'status' then 'column_not_owned' else 'clears_value' end as violation from {WRITES.sql}
    where column_id = 'status' or coalesce(value, '') = ''
    """,
)
def owned_column_violations(spark, sf):
    return design.write_violations(WRITES.df(spark, sf))


@query(
    "counter_by_state",
    f"select state, count(*) as n from (select case when state = 'failed' then null else state end as state from {t.DESIGN_ITEMS.whole.sql}) where state is not null group by 1",
)
def counter_by_state(spark, sf):
    rows = t.DESIGN_ITEMS.whole.df(spark, sf).withColumn("state", F.when(F.col("state") != "failed", F.col("state")))
    return metrics.counter(rows, "state")


@query(
    "nearest_rank_percentiles",
    """
    select event_type, unnest([0.5, 0.95, 0.99])::double as p, round(unnest(quantile_disc(value, [0.5, 0.95, 0.99])), 3) as value from events group by 1
    """,
)
def nearest_rank_percentiles(spark, sf):
    return metrics.nearest_rank(table(spark, sf, "events"), "value", (0.5, 0.95, 0.99), ["event_type"], width=5.0)


@query(
    "operations_metrics",
    f"""
    with j as (select *, status in {DESIGN_ACTIVE} and execution_kind is null and coalesce(stage in ('waiting_for_name', 'waiting_for_email'), false) as w,
        round(greatest(0, epoch_us({N}) - epoch_us(coalesce(heartbeat_at, locked_at))) / 1e6, 3) as beat, round(greatest(0, epoch_us({N}) - epoch_us(created_at)) / 1e6, 3) as age,
        case when execution_kind = 'publication' and status = 'completed' and started_at is not null then round(greatest(0, epoch_us(completed_at) - epoch_us(started_at)) / 1e6, 3) end as latency from {t.DESIGN_JOBS.sql}),
    i as (select count(*) filter (supersession_requested_at is not null) as pending, count(*) filter (d_r is not null and (d_r, d_v) is not distinct from (a_r, a_v) and (d_r, d_v) is distinct from (p_r, p_v)) as anp from {t.DESIGN_ITEMS.whole.sql}),
    a as (select count(*) filter (status = 'delete_pending') as dp, count(*) filter (status = 'delete_pending' and coalesce(last_error, '') <> '') as dpe, count(*) filter (status = 'deleted') as de from {t.ARTIFACTS.sql})
    select count(*) filter (w) as readiness_waiting_jobs, max(age) filter (w) as readiness_oldest_age_seconds, sum(readiness_check_count) filter (w)::bigint as readiness_checks_total,
      quantile_disc(readiness_check_count, 0.95) filter (w)::double as readiness_checks_p95, count(*) as attempts_jobs, sum(attempt_count)::bigint as attempts_total,
      quantile_disc(attempt_count, 0.5)::double as attempts_p50, quantile_disc(attempt_count, 0.95)::double as attempts_p95, count(*) filter (status = 'running') as leases_running,
      count(*) filter (status = 'running' and beat >= 3600) as leases_expired, max(beat) filter (status = 'running') as leases_oldest_heartbeat_age_seconds,
      count(*) filter (status = 'cancelled' and superseded_by_revision is not null) as supersessions_cancelled_jobs, any_value(pending) as supersessions_pending_items, any_value(anp) as analyzed_not_published,
      any_value(dp) as cleanup_delete_pending, any_value(dpe) as cleanup_delete_pending_with_errors, any_value(de) as cleanup_deleted, count(latency) as publication_latency_count,
      quantile_disc(latency, 0.5) as publication_latency_p50, quantile_disc(latency, 0.95) as publication_latency_p95,
      (select string_agg(status || '=' || n, ',' order by status) from (select status, count(*) as n from j where status in {DESIGN_ACTIVE} group by 1)) as queue_depth,
      (select string_agg(state || '=' || n, ',' order by state) from (select state, count(*) as n from {t.DESIGN_ITEMS.whole.sql} group by 1)) as items_by_state
    from j, i, a
    """,
)
def operations_metrics(spark, sf):
    row = metrics.operations_metrics(
        t.design_items(spark, sf, whole=True), t.DESIGN_JOBS.df(spark, sf), t.ARTIFACTS.df(spark, sf), DISPATCHES.df(spark, sf), now=now()
    )

    def listed(name):
        pairs = F.transform(F.map_entries(name), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
        return F.array_join(F.array_sort(pairs), ",").alias(name)

    out = row.drop("schema_version", "collected_at", "dispatch_status", "dispatch_outcome")
    return out.select(*[listed(c) if c in ("queue_depth", "items_by_state") else F.col(c) for c in out.columns])


@query("dispatch_counters", f"select status, count(*) as n from {DISPATCHES.sql} where consumer = 'design_processing' group by 1")
def dispatch_counters(spark, sf):
    mine = DISPATCHES.df(spark, sf).filter("consumer = 'design_processing'")
    return metrics.counter(mine, "status")


INTEGRITY_JOBS = Proxy(
    "lineitem",
    {
        **{k: v for k, v in t.DESIGN_JOBS.columns.items() if k not in ("status", "stage", "attempt_count", "execution_kind")},
        "status": "case when l_partkey % 500 = 3 then 'lost' else (" + t.DESIGN_JOBS.columns["status"] + ") end",
        "stage": "case when l_suppkey % 50 = 7 then 'nowhere' else (" + t.DESIGN_JOBS.columns["stage"] + ") end",
        "execution_kind": "case when l_partkey % 400 = 9 then 'other' else (" + t.DESIGN_JOBS.columns["execution_kind"] + ") end",
        "attempt_count": "case when l_partkey % 300 = 5 then -1 else l_linenumber % 4 end",
    },
)
_ROW_RULES = [
    ("job_status", "status = 'lost'"),
    ("job_stage", "stage = 'nowhere'"),
    ("job_kind", "execution_kind = 'other'"),
    ("job_counters", "attempt_count < 0"),
]


@query(
    "integrity_violations",
    " union all ".join(f"select '{r}' as rule, id as key, 1::bigint as n from {INTEGRITY_JOBS.sql} where {c}" for r, c in _ROW_RULES)
    + f"""
    union all select 'one_active_job', board_id || ':' || item_id, count(*) from {INTEGRITY_JOBS.sql} where status in {DESIGN_ACTIVE} group by board_id, item_id having count(*) > 1
    union all select 'snapshot_unique', external_task_key || ':' || snapshot_version, count(*) from {t.SNAPSHOTS.sql} group by external_task_key, snapshot_version having count(*) > 1
    """,
)
def integrity_violations(spark, sf):
    return quality.integrity_violations(design_jobs=INTEGRITY_JOBS.df(spark, sf), snapshots=t.SNAPSHOTS.df(spark, sf))

