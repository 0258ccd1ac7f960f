"""Queries over change events, derived from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from worklens import vocab
from worklens.functions import dates
from worklens.operators import events as ops
from worklens.plans import lifecycle
from worklens.plans.policy import Policy, classify
from worklens.queries.base import Proxy, query, sql_stamp, stamp, table
from worklens.session import new_shared_path
from worklens.streaming import events as stream_ops, keyed_bursts

NOW = "timestamp '2024-01-20 00:00:00'"

# Raw payloads in four shapes: trigger id, event id with subscription, addressed, bare.
PAYLOADS = Proxy(
    "events",
    {
        "row_id": "event_id",
        "received_at": "cast(ts as timestamp)",
        "payload": (
            "case when event_id % 4 = 0 then concat('{\"event\": {\"triggerUuid\": \" t-', cast(user_id as string), '-', event_type, '\", \"boardId\": ', "
            "cast(user_id % 5 as string), ', \"pulseId\": ', cast(user_id as string), ', \"type\": \"', event_type, '\"}}') "
            "when event_id % 4 = 1 then concat('{\"event_id\": ', cast(event_id as string), ', \"app_webhook_id\": \"s', cast(user_id % 3 as string), "
            "'\", \"pulse_board_id\": \"b', cast(user_id % 5 as string), '\", \"boardId\": \"  \", \"event\": \"', event_type, '\"}') "
            "when event_id % 4 = 2 then concat('{\"itemId\": ', cast(user_id as string), ', \"board_id\": 7, \"eventType\": \"', event_type, '\"}') "
            "else concat('{\"destGroupId\": \"g', cast(user_id % 4 as string), '\", \"columnId\": \"c\"}') end"
        ),
    },
)


@query(
    "event_normalisation",
    """
    select event_id as row_id,
      case event_id % 4 when 0 then (user_id % 5)::varchar when 1 then 'b' || (user_id % 5) when 2 then '7' end as board_id,
      case when event_id % 4 in (0, 2) then user_id::varchar end as item_id,
      case when event_id % 4 < 3 then event_type end as event_type,
      case when event_id % 4 = 3 then 'c' end as column_id,
      case when event_id % 4 = 3 then 'g' || (user_id % 4) end as group_id,
      case event_id % 4 when 0 then 'trigger:t-' || user_id || '-' || event_type
        when 1 then 'event:s' || (user_id % 3) || ':' || event_id
        when 2 then 'payload:7:' || user_id || ':' || event_type || ':' ||
          sha256('{"board_id":7,"eventType":"' || event_type || '","itemId":' || user_id || '}')
        else 'payload:' || sha256('{"columnId":"c","destGroupId":"g' || (user_id % 4) || '"}') end as idempotency_key
    from events
    """,
)
def event_normalisation(spark, sf):
    rows = ops.normalize(PAYLOADS.df(spark, sf))
    return rows.select("row_id", "board_id", "item_id", "event_type", "column_id", "group_id", "idempotency_key")


TYPED = Proxy(
    "events",
    {
        "event_id": "event_id",
        "event_type": (
            "case event_type when 'signup' then 'Create_Pulse' when 'view' then ' move_pulse_into_group' "
            "when 'click' then 'update_column_value' when 'error' then 'change_name' else event_type end"
        ),
        "column_id": (
            f"case user_id % 5 when 0 then '{vocab.AI_DATA_COLUMN}' when 1 then '{vocab.EMAIL_COLUMN}' when 2 then 'name' "
            "when 3 then 'other' else cast(null as string) end"
        ),
    },
)


@query(
    "event_trigger_types",
    f"""
    with e as (select *, lower(trim(event_type)) as t from {TYPED.sql})
    select event_id, case when column_id = '{vocab.AI_DATA_COLUMN}' then null when t = 'create_pulse' then 'webhook_create'
      when t = 'move_pulse_into_group' then 'webhook_move' when column_id = '{vocab.EMAIL_COLUMN}' then 'webhook_email'
      when column_id = 'name' or t = 'change_name' then 'webhook_name' end as trigger_type from e
    """,
)
def event_trigger_types(spark, sf):
    e = TYPED.df(spark, sf)
    return e.select("event_id", ops.trigger_type("event_type", "column_id").alias("trigger_type"))


DELIVERIES = Proxy(
    "events",
    {
        "event_id": "event_id",
        "received_at": "cast(ts as timestamp)",
        "item_id": "user_id",
        "idempotency_key": "concat(cast(user_id as string), ':', event_type)",
    },
)
_FIRST = f"""
    with r as (select *, row_number() over (partition by idempotency_key order by received_at, event_id) as rn from {DELIVERIES.sql})
    select idempotency_key, event_id, item_id from r where rn = 1
    """


@query("event_first_deliveries", _FIRST)
def event_first_deliveries(spark, sf):
    first = ops.first_deliveries(DELIVERIES.df(spark, sf), ["received_at", "event_id"])
    return first.select("idempotency_key", "event_id", "item_id")


DISPATCHES = Proxy(
    "events",
    {
        "event_id": "user_id",
        "dispatch_id": "event_id",
        "consumer": "case when event_id % 2 = 0 then 'auto_sync' else 'design_processing' end",
        "status": (
            "case when user_id % 7 = 0 then 'succeeded' when user_id % 7 = 1 then 'failed' when event_type = 'error' then 'failed' "
            "when event_type = 'view' and user_id % 7 = 2 then 'pending' when event_type = 'click' and user_id % 7 = 3 then 'processing' else 'succeeded' end"
        ),
        "outcome": "case when user_id % 5 = 0 then 'ignored' when event_type = 'signup' and user_id % 5 < 3 then 'queued' when user_id % 5 = 3 then 'excluded' else 'ignored' end",
        "reason": "case when user_id % 2 = 0 then 'completed_retention_only' else 'unknown_group' end",
        "processing_started_at": "case when event_id % 3 = 0 then cast(null as timestamp) else cast(ts as timestamp) end",
        "result_json": (
            "case event_id % 4 when 0 then '{\"retryable\": false}' when 1 then '{\"retryable\": true}' when 2 then '{\"retryable\": null}' else cast(null as string) end"
        ),
    },
)
_PARENT = f"""
    select event_id, case when bool_and(status = 'succeeded') then 'completed' when bool_and(status = 'failed') then 'failed'
        when bool_or(status in ('pending', 'processing')) then 'processing' else 'partial_failed' end as event_status,
      case when bool_or(status = 'failed') then 'failed consumers: ' ||
        string_agg(distinct case when status = 'failed' then consumer end, ', ' order by case when status = 'failed' then consumer end) end as error
    from {DISPATCHES.sql} group by 1
    """


@query("event_parent_status", _PARENT)
def event_parent_status(spark, sf):
    return ops.parent_status(DISPATCHES.df(spark, sf))


@query(
    "event_response_status",
    f"""
    with p as ({_PARENT}),
    o as (select event_id, max(case when consumer = 'auto_sync' then outcome end) as a, max(case when consumer = 'auto_sync' then reason end) as r,
      max(case when consumer = 'design_processing' then outcome end) as d from {DISPATCHES.sql} group by 1)
    select event_id, case when event_status <> 'completed' then event_status when a in ('queued', 'coalesced') or d in ('queued', 'coalesced') then 'queued'
      when r = 'completed_retention_only' then 'retained' when a = 'excluded' then 'cancelled' else 'ignored' end as response_status
    from p join o using (event_id)
    """,
)
def event_response_status(spark, sf):
    return ops.response_status(DISPATCHES.df(spark, sf))


_CLAIMABLE = f"""
    select * from {DISPATCHES.sql} where status = 'pending'
      or (status = 'processing' and (processing_started_at is null or processing_started_at <= {NOW} - interval 5 minutes))
      or (status = 'failed' and coalesce(result_json, '') not in ('{{"retryable": false}}', '{{"retryable": null}}'))
    """


@query("dispatch_reclaim", f"select event_id, dispatch_id, consumer, status from ({_CLAIMABLE})")
def dispatch_reclaim(spark, sf):
    found = ops.claimable_dispatches(DISPATCHES.df(spark, sf), F.expr(NOW))
    return found.select("event_id", "dispatch_id", "consumer", "status")


STORED = Proxy(
    "events",
    {
        "event_id": "user_id",
        "idempotency_key": "concat(cast(user_id as string), ':', event_type)",
        "status": "case event_type when 'error' then 'failed' when 'view' then 'processing' when 'click' then 'received' else 'completed' end",
        "processing_started_at": "cast(ts as timestamp)",
    },
    # Keys that are not stored yet are new.
    where="event_type <> 'signup'",
)


@query(
    "event_claims",
    f"""
    with f as ({_FIRST}),
    st as (select distinct on (idempotency_key) * from (select * from {STORED.sql} order by idempotency_key, processing_started_at)),
    d as (select event_id, count(*) as n from {DISPATCHES.sql} group by 1), o as (select distinct event_id from ({_CLAIMABLE}))
    select f.idempotency_key, f.event_id, case when st.idempotency_key is null then 'new'
      when st.status = 'received' or (st.status = 'processing' and st.processing_started_at <= {NOW} - interval 5 minutes)
        or (st.status in ('failed', 'partial_failed') and (d.n is null or o.event_id is not null)) then 'reclaimed' else 'duplicate' end as claim
    from f left join st using (idempotency_key) left join d on d.event_id = st.event_id left join o on o.event_id = st.event_id
    """,
)
def event_claims(spark, sf):
    from worklens.scale import keep_first

    stored = keep_first(STORED.df(spark, sf), ["idempotency_key"], [F.col("processing_started_at")])
    first = ops.first_deliveries(DELIVERIES.df(spark, sf), ["received_at", "event_id"])
    claims = ops.claim_events(first, stored, DISPATCHES.df(spark, sf), F.expr(NOW))
    return claims.select("idempotency_key", "event_id", "claim")


@query(
    "event_fan_out",
    "select event_id, event_type, unnest(['auto_sync', 'design_processing']) as consumer, 'pending' as status from events",
)
def event_fan_out(spark, sf):
    return ops.fan_out(table(spark, sf, "events").select("event_id", "event_type"))


BURSTS = Proxy(
    "events",
    {
        "item_id": "user_id",
        "event_id": "event_id",
        "received_at": "cast(ts as timestamp)",
        "trigger_type": "event_type",
        "desired_source_revision": "case when event_id % 3 = 0 then cast(null as string) else concat('r', cast(event_id as string)) end",
    },
)
GAP_SECONDS = 7200
_BURSTS = f"""
    with g as (select *, case when received_at - lag(received_at) over w <= interval 2 hours then 0 else 1 end as s
      from {BURSTS.sql} window w as (partition by item_id order by received_at, event_id)),
    i as (select *, sum(s) over (partition by item_id order by received_at, event_id) as burst from g)
    select item_id, {sql_stamp('min(received_at)')} as first_at, {sql_stamp('max(received_at) + interval 2 hours')} as scheduled_for,
      count(*) as n_events, arg_max(trigger_type, (received_at, event_id)) as trigger_type,
      arg_max(desired_source_revision, (received_at, event_id)) filter (desired_source_revision is not null) as desired_source_revision
    from i group by item_id, burst
    """


def _shown(jobs):
    return jobs.select(
        "item_id",
        stamp("first_at").alias("first_at"),
        stamp("scheduled_for").alias("scheduled_for"),
        "n_events",
        "trigger_type",
        "desired_source_revision",
    )


@query("event_debounce", _BURSTS)
def event_debounce(spark, sf):
    return _shown(ops.debounce(BURSTS.df(spark, sf), ["item_id"], gap_seconds=GAP_SECONDS))


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")


@query(
    "stream_first_deliveries",
    "select distinct concat(user_id, ':', event_type) as idempotency_key from events",
)
def stream_first_deliveries(spark, sf):
    rows = _event_stream(spark, sf).selectExpr(*[f"{e} as {n}" for n, e in DELIVERIES.columns.items()])
    out = new_shared_path(spark, "first-deliveries")
    once = stream_ops.first_deliveries(rows)
    stream_ops.run_available(once, f"{out}/checkpoint", f"{out}/data").awaitTermination()
    return spark.read.parquet(f"{out}/data").select("idempotency_key")


@query(
    "stream_late_deliveries",
    f"""
    with r as (select *, row_number() over (partition by idempotency_key order by event_id % 4 desc, received_at, event_id) as rn from {DELIVERIES.sql})
    select idempotency_key, event_id, item_id from r where rn = 1
    """,
)
def stream_late_deliveries(spark, sf):
    """Four files of old and new events, one micro-batch each: the stored rows as they are, so a lost or doubled key shows."""
    rows = DELIVERIES.df(spark, sf)
    out = new_shared_path(spark, "late-deliveries")
    for part in (3, 2, 1, 0):
        rows.filter(F.col("event_id") % 4 == part).coalesce(1).write.mode("append").parquet(f"{out}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    order = ("received_at", "event_id")
    stream_ops.run_first_deliveries(stream, f"{out}/checkpoint", f"{out}/data", order=order).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/data").select("idempotency_key", "event_id", "item_id")


#: Missing, broken and trailing texts are rejects; repeated members are readable.
BROKEN = Proxy(
    "events",
    {
        "event_id": "event_id",
        "received_at": "cast(ts as timestamp)",
        "payload": (
            "case when event_type = 'error' then cast(null as string) when event_type = 'view' then concat('{broken ', cast(event_id as string)) "
            "when event_type = 'click' then concat('{\"triggerUuid\": \"t', cast(event_id as string), '\"} and more') "
            "when event_type = 'signup' then concat('{\"a\": 1, \"a\": 2, \"triggerUuid\": \"t', cast(event_id as string), '\"}') "
            "else concat('{\"event\": \"{text}\", \"triggerUuid\": \"t', cast(event_id as string), '\"}') end"
        ),
    },
)


@query(
    "rejected_events",
    """
    select event_id, case event_type when 'error' then 'missing' when 'view' then 'unreadable' when 'click' then 'unreadable' end as reject_reason,
      case when event_type not in ('error', 'view', 'click') then 'trigger:t' || event_id end as idempotency_key from events
    """,
)
def rejected_events(spark, sf):
    """Every row is either a delivery with a key or a reject with a reason."""
    events = BROKEN.df(spark, sf)
    rejects = ops.rejected(events).select("event_id", "reject_reason", F.lit(None).cast("string").alias("idempotency_key"))
    keyed = ops.first_deliveries(ops.normalize(events.withColumnRenamed("event_id", "row_id")))
    return rejects.unionByName(
        keyed.select(F.col("row_id").alias("event_id"), F.lit(None).cast("string").alias("reject_reason"), "idempotency_key")
    )


@query("stream_debounce", _BURSTS)
def stream_debounce(spark, sf):
    rows = _event_stream(spark, sf).selectExpr(*[f"{e} as {n}" for n, e in BURSTS.columns.items()])
    out = new_shared_path(spark, "debounce")
    stream_ops.run_debounce(rows, ["item_id"], f"{out}/checkpoint", f"{out}/data", GAP_SECONDS).awaitTermination()
    return _shown(stream_ops.bursts(spark, ["item_id"], f"{out}/data", GAP_SECONDS))


@query("stream_keyed_bursts", _BURSTS)
def stream_keyed_bursts(spark, sf):
    """Six micro-batches in no order; each hands on only the bursts that it changes."""
    rows = BURSTS.df(spark, sf)
    out = new_shared_path(spark, "keyed-bursts")
    rows.repartition(6, F.xxhash64("event_id")).write.parquet(f"{out}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    keyed_bursts.run_keyed_bursts(stream, ["item_id"], f"{out}/checkpoint", f"{out}/data", GAP_SECONDS, page=8).awaitTermination()
    return _shown(keyed_bursts.current_bursts(spark, ["item_id"], f"{out}/data", GAP_SECONDS))


POLICY = Policy("b1", ("g0", "g1"), ("g2",), "g3")
CURRENT = Proxy(
    "orders",
    {
        "item_id": "o_orderkey",
        "board_id": "case when o_custkey % 10 = 0 then 'b2' else 'b1' end",
        "group_id": "concat('g', cast(o_custkey % 5 as string))",
        "item_state": "case when o_orderstatus = 'P' then 'archived' else 'active' end",
        "source_revision": "concat('r', cast(o_orderkey % 9 as string))",
    },
)
DECISION = """case when board_id <> 'b1' then 'board_not_managed' when group_id = 'g2' then 'excluded_group'
    when group_id in ('g0', 'g1') then 'active_group' when group_id = 'g3' then 'completed_retention_only' else 'unknown_group' end"""


@query(
    "event_current_state",
    f"""
    with e as (select event_id, user_id as item_id from events), c as (select *, {DECISION} as reason from {CURRENT.sql})
    select event_id, item_id, c.group_id as current_group_id, c.item_state, c.reason from e left join c using (item_id)
    """,
)
def event_current_state(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.col("user_id").alias("item_id"))
    current = CURRENT.df(spark, sf).withColumn("reason", classify(POLICY, "board_id", "group_id")["reason"])
    joined = stream_ops.with_current_item(events, current)
    reasons = current.select("item_id", "reason")
    return joined.join(reasons, "item_id", "left").select("event_id", "item_id", "current_group_id", "item_state", "reason")


@query(
    "stream_pinned_items",
    f"""
    select event_id, user_id as item_id, case when c.item_id is not null then 'g' || ((o_custkey + event_id % 3) % 5) end as current_group_id, 'v' || (event_id % 3) as item_version
    from events left join (select o_orderkey as item_id, o_custkey from orders) c on c.item_id = user_id
    """,
)
def stream_pinned_items(spark, sf):
    """Three micro-batches while the item table changes: every event is decided by the version of its batch."""
    rows = table(spark, sf, "events").select("event_id", F.col("user_id").alias("item_id"))
    out = new_shared_path(spark, "pinned-items")
    for part in range(3):
        rows.filter(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(f"{out}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    versions = iter(("v0", "v1", "v2"))

    def items_at(version):
        moved = ((F.col("o_custkey") + int(version[1:])) % 5).cast("string")
        items = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), F.concat(F.lit("g"), moved).alias("group_id"))
        return items.withColumns({"item_state": F.lit("active"), "source_revision": F.lit(version)})

    stream_ops.run_current_items(stream, f"{out}/checkpoint", f"{out}/data", lambda: next(versions), items_at).awaitTermination()
    return spark.read.parquet(f"{out}/data").select("event_id", "item_id", "current_group_id", "item_version")


SYNC_EVENTS = Proxy(
    "events",
    {
        "event_id": "event_id",
        "board_id": "case when event_id % 11 = 0 then 'b9' else 'b1' end",
        "item_id": "case when event_id % 13 = 0 then '' else cast(user_id as string) end",
    },
)
SYNC_PLAN = Proxy(
    "customer",
    {
        "item_id": "cast(c_custkey as string)",
        "job_action": "case c_custkey % 4 when 0 then 'create' when 1 then 'coalesce' when 2 then 'retarget_running' else 'none' end",
        "lifecycle_state": "case when c_custkey % 8 = 3 then 'excluded' else 'active' end",
        "reason": "case when c_custkey % 8 = 3 then 'excluded_group' when c_custkey % 16 = 7 then 'auto_sync_disabled' else 'active_group' end",
    },
)


@query(
    "sync_dispatch_outcomes",
    f"""
    select e.event_id, 'auto_sync' as consumer, 'succeeded' as status,
      case when e.board_id <> 'b1' or e.item_id = '' then 'ignored' when p.job_action = 'create' then 'queued'
        when p.job_action <> 'none' then 'coalesced' when p.lifecycle_state = 'excluded' then 'excluded'
        when p.reason = 'auto_sync_disabled' then 'disabled' else 'ignored' end as outcome,
      case when e.board_id <> 'b1' then 'board_not_managed' when e.item_id = '' then 'missing_item_id' else p.reason end as reason
    from {SYNC_EVENTS.sql} e left join {SYNC_PLAN.sql} p using (item_id)
    """,
)
def sync_dispatch_outcomes(spark, sf):
    return lifecycle.sync_dispatch_outcome(SYNC_EVENTS.df(spark, sf), SYNC_PLAN.df(spark, sf), POLICY)


@query(
    "event_log_lines",
    f"""
    select event_id, '{vocab.EVENT_LOG_PREFIX}' || '{{"event":"webhook_child_completed","item_id":"' || user_id || '","outcome":'
      || case when event_type = 'error' then 'null' else '"' || event_type || '"' end
      || ',"timestamp":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '"}}' as line from events
    """,
)
def event_log_lines(spark, sf):
    e = table(spark, sf, "events")
    fields = {
        "item_id": F.col("user_id").cast("string"),
        "outcome": F.when(F.col("event_type") != "error", F.col("event_type")),
    }
    return e.select("event_id", ops.log_line("webhook_child_completed", stamp("ts"), fields).alias("line"))


@query(
    "event_log_reader",
    "select event_type as event, count(*) as n from events group by 1",
)
def event_log_reader(spark, sf):
    e = table(spark, sf, "events")
    lines = e.select(ops.log_line("x", stamp("ts"), {"outcome": F.col("event_type")}).alias("value"))
    parsed = ops.read_log(lines, "event string, outcome string, timestamp string")
    return parsed.groupBy(F.col("outcome").alias("event")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "event_ages",
    f"""
    select event_id, round(greatest(0, epoch_us({NOW}) - epoch_us(ts)) / 1e6, 3) as age_seconds from events
    """,
)
def event_ages(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", dates.age_seconds(F.expr(NOW), "ts").alias("age_seconds"))
