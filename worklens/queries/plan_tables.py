"""Tables of the life cycle, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from worklens.plans.policy import Policy, identity
from worklens.queries.base import Proxy

NOW = "timestamp '1999-06-01 12:00:00'"
POLICY = Policy("b1", ("g0", "g1"), ("g2",), "g3")

_BOARD = "case when {k} % 10 = 0 then 'b2' else 'b1' end"
_KEY = "concat('a', cast({k} % 7 as string), ':', " + _BOARD + ", ':', cast({k} as string))"
O_BOARD, O_KEY = _BOARD.format(k="o_orderkey"), _KEY.format(k="o_orderkey")
L_BOARD, L_KEY = _BOARD.format(k="l_orderkey"), _KEY.format(k="l_orderkey")
O_TIME = "cast(o_orderdate as timestamp)"
L_TIME = "cast(l_shipdate as timestamp)"
NULL_TEXT = "cast(null as string)"
NULL_TIME = "cast(null as timestamp)"

DECISION = {
    "state": "case when board_id <> 'b1' then null when group_id = 'g2' then 'excluded' when group_id in ('g0', 'g1') then 'active' when group_id = 'g3' then 'completed_retained' end",
    "reason": "case when board_id <> 'b1' then 'board_not_managed' when group_id = 'g2' then 'excluded_group' when group_id in ('g0', 'g1') then 'active_group' when group_id = 'g3' then 'completed_retention_only' else 'unknown_group' end",
}

ITEMS = Proxy(
    "orders",
    {
        "external_task_key": O_KEY,
        "account_id": "concat('a', cast(o_orderkey % 7 as string))",
        "board_id": O_BOARD,
        "item_id": "cast(o_orderkey as string)",
        "group_id": "concat('g', cast(o_custkey % 5 as string))",
        "group_title": "o_orderpriority",
        "source_revision": "concat('r', cast(o_custkey % 3 as string))",
        "desired_source_revision": f"case when o_custkey % 4 = 0 then {NULL_TEXT} else concat('r', cast(o_custkey % 3 as string)) end",
        "source_pos": "o_orderkey",
        "created_at": O_TIME,
    },
)

TASKS = Proxy(
    "orders",
    {
        "external_task_key": O_KEY,
        "account_id": "concat('a', cast(o_orderkey % 7 as string))",
        "board_id": O_BOARD,
        "item_id": "cast(o_orderkey as string)",
        "auto_sync_state": (
            "case when o_orderstatus = 'O' then 'active' when o_orderstatus = 'F' then 'completed_retained' when o_orderkey % 4 = 0 then 'excluded' "
            "when o_orderkey % 4 = 1 then 'expired' when o_orderkey % 4 = 2 then 'purge_pending' else 'storage_deleting' end"
        ),
        "sync_status": f"case o_orderkey % 6 when 0 then 'queued' when 1 then 'syncing' when 2 then 'failed' when 5 then {NULL_TEXT} else 'completed' end",
        "sync_started_at": f"case when o_custkey % 5 = 0 then {NULL_TIME} else {O_TIME} end",
        "sync_requested_at": f"case when o_custkey % 6 = 0 then {NULL_TIME} else {O_TIME} end",
        "last_indexed_source_revision": f"case when o_custkey % 8 = 0 then {NULL_TEXT} else concat('r', cast(o_orderkey % 3 as string)) end",
        "latest_snapshot_version": f"case when o_custkey % 9 = 0 then {NULL_TEXT} else concat('r', cast(o_orderkey % 4 as string)) end",
        "completed_at": f"case when o_orderstatus = 'F' then {O_TIME} end",
        "purge_after": f"case when o_custkey % 11 = 0 then {NULL_TIME} else {O_TIME} + interval '30' day end",
        "retention_hold": "case when o_custkey % 3 = 0 then cast(null as boolean) else o_custkey % 3 = 1 end",
        "raw_purged_at": NULL_TIME,
        "sync_error": f"case when o_orderkey % 6 = 2 then 'failed before' else {NULL_TEXT} end",
        "last_sync_result": "'done'",
        "updated_at": f"{O_TIME} + interval '1' hour",
    },
    # The items without a task or state: what plans do about them is the feature.
    where="o_orderpriority <> '5-LOW'",
)

SYNC_JOBS = Proxy(
    "lineitem",
    {
        "id": "concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string), '-', cast(cast(round(l_extendedprice * 100) as bigint) as string))",
        "external_task_key": L_KEY,
        "board_id": L_BOARD,
        "item_id": "cast(l_orderkey as string)",
        "status": (
            "case l_partkey % 24 when 0 then 'pending' when 1 then 'scheduled' when 2 then 'running' when 3 then 'retry_wait' when 4 then 'skipped' when 5 then 'failed' when 6 then 'cancelled' else 'completed' end"
        ),
        "trigger_type": "case when l_returnflag = 'A' then 'webhook' else 'reconciliation' end",
        "desired_source_revision": f"case when l_suppkey % 3 = 0 then {NULL_TEXT} else concat('r', cast(l_suppkey % 4 as string)) end",
        "scheduled_for": L_TIME,
        "next_retry_at": f"case when l_suppkey % 4 = 0 then {NULL_TIME} else {L_TIME} + interval '2' hour end",
        "attempt_count": "l_linenumber % 4",
        "max_attempts": "3",
        "locked_at": f"case when l_suppkey % 7 = 0 then {NULL_TIME} else {L_TIME} + interval '1' hour end",
        "heartbeat_at": f"case when l_suppkey % 5 = 0 then {NULL_TIME} else {L_TIME} + interval '400' day end",
        "created_at": f"{L_TIME} - interval '1' day",
        "result": "case when l_suppkey % 2 = 0 then 'done' else 'unchanged' end",
        "last_error": "repeat(l_returnflag, 600)",
        "changed_at": f"{L_TIME} + interval '3' hour",
    },
)

SNAPSHOTS = Proxy(
    "lineitem",
    {
        "id": SYNC_JOBS.columns["id"],
        "external_task_key": L_KEY,
        "snapshot_version": "concat('r', cast(l_linenumber % 4 as string))",
        "ingestion_status": "case l_returnflag when 'A' then 'complete' when 'N' then 'building' else 'failed' end",
        "created_at": L_TIME,
    },
)


def _pair(prefix: str, revision: str, version: str, absent: str) -> dict[str, str]:
    return {
        f"{prefix}_r": f"case when {absent} then {NULL_TEXT} else {revision} end",
        f"{prefix}_v": f"case when {absent} then {NULL_TEXT} else {version} end",
    }


DESIGN_ITEMS = Proxy(
    "orders",
    {
        "board_id": O_BOARD,
        "item_id": "cast(o_orderkey as string)",
        "state": (
            "case o_orderkey % 9 when 0 then 'waiting_for_name' when 1 then 'waiting_for_email' when 2 then 'scheduled' when 3 then 'processing' when 4 then 'analyzed' "
            "when 5 then 'publishing' when 6 then 'ready_for_review' when 7 then 'ineligible' else 'failed' end"
        ),
        **_pair("d", "concat('r', cast(o_custkey % 2 as string))", "case when o_custkey % 5 = 0 then 'p0' else 'p1' end", "o_orderkey % 8 = 0"),
        **_pair("a", "concat('r', cast(o_orderkey % 2 as string))", "case when o_orderkey % 5 = 1 then 'p0' else 'p1' end", "o_custkey % 6 = 0"),
        **_pair("p", "concat('r', cast((o_orderkey + o_custkey) % 2 as string))", "'p1'", "o_custkey % 4 = 0"),
        "supersession_requested_at": f"case when o_custkey % 7 = 0 then {O_TIME} else {NULL_TIME} end",
    },
    # The items without a task or state: what plans do about them is the feature.
    where="o_orderpriority <> '5-LOW'",
)

DESIGN_SNAPSHOTS = Proxy(
    "orders",
    {
        "item_id": "cast(o_orderkey as string)",
        "board_id": "case when o_orderkey % 10 = 0 then 'b2' else 'b1' end",
        "group_id": "case when o_custkey % 9 = 0 then 'g9' else 'g0' end",
        "item_state": "case when o_orderkey % 19 = 0 then 'archived' else 'active' end",
        "missing_name": "o_orderkey % 12 = 1",
        "missing_email": "o_orderkey % 12 = 2",
        "input_revision": f"case when o_orderkey % 12 = 2 then {NULL_TEXT} else concat('r', cast(o_custkey % 3 as string)) end",
        "created_at": O_TIME,
        "source_pos": "o_orderkey",
    },
)

DESIGN_JOBS = Proxy(
    "lineitem",
    {
        "id": SYNC_JOBS.columns["id"],
        "board_id": L_BOARD,
        "item_id": "cast(l_orderkey as string)",
        "status": "case l_partkey % 12 when 0 then 'scheduled' when 1 then 'running' when 2 then 'retry_wait' when 3 then 'failed' when 4 then 'cancelled' else 'completed' end",
        "stage": f"case l_suppkey % 4 when 0 then 'waiting_for_name' when 1 then 'waiting_for_email' when 2 then 'matching' else {NULL_TEXT} end",
        "execution_kind": f"case l_suppkey % 3 when 0 then 'analysis' when 1 then 'publication' else {NULL_TEXT} end",
        **_pair("e", "concat('r', cast(l_partkey % 2 as string))", "case when l_partkey % 7 = 0 then 'p0' else 'p1' end", "l_suppkey % 3 = 2"),
        "scheduled_for": L_TIME,
        "next_retry_at": SYNC_JOBS.columns["next_retry_at"],
        "attempt_count": "l_linenumber % 4",
        "max_attempts": "3",
        "readiness_check_count": "l_linenumber",
        "locked_by": "case when l_suppkey % 11 = 0 then 'w2' else 'w1' end",
        "locked_at": SYNC_JOBS.columns["locked_at"],
        "heartbeat_at": SYNC_JOBS.columns["heartbeat_at"],
        "created_at": SYNC_JOBS.columns["created_at"],
        "started_at": f"case when l_suppkey % 13 = 0 then {NULL_TIME} else {L_TIME} end",
        "completed_at": f"{L_TIME} + interval '1' minute * l_partkey",
        "superseded_by_revision": f"case when l_suppkey % 2 = 0 then 'r1' else {NULL_TEXT} end",
    },
)

ARTIFACTS = Proxy(
    "lineitem",
    {
        "id": SYNC_JOBS.columns["id"],
        "board_id": L_BOARD,
        "item_id": "cast(l_orderkey as string)",
        "artifact_kind": "case l_partkey % 3 when 0 then 'ai_data' when 1 then 'ai_data_pdf' else 'match_report' end",
        "column_id": "case when l_partkey % 3 = 2 then 'file_mm59rntf' else 'file_mkza7y37' end",
        "input_revision": "concat('r', cast(l_suppkey % 2 as string))",
        "pipeline_version": "'p1'",
        "deterministic_filename": "concat('f', cast(l_partkey % 4 as string))",
        "content_sha256": "l_returnflag",
        "size_bytes": "cast(l_quantity as bigint)",
        "asset_id": f"case when l_suppkey % 9 = 0 then {NULL_TEXT} else cast(l_partkey as string) end",
        "status": "case l_suppkey % 10 when 0 then 'delete_pending' when 1 then 'deleted' when 2 then 'uploading' when 3 then 'failed' else 'published' end",
        "last_error": f"case when l_linenumber = 1 then 'e' when l_linenumber = 2 then '' else {NULL_TEXT} end",
        "updated_at": L_TIME,
    },
)

FILES = Proxy(
    "lineitem",
    {
        "id": SYNC_JOBS.columns["id"],
        "external_task_key": L_KEY,
        "snapshot_id": "cast(l_suppkey as string)",
        "asset_id": "cast(l_partkey as string)",
        "bucket": "'files'",
        "object_path": "concat('p/', cast(l_partkey as string))",
        "storage_status": "case when l_linestatus = 'O' then 'stored' else 'unsupported' end",
        "deleted_at": f"case when l_suppkey % 6 = 0 then {L_TIME} else {NULL_TIME} end",
        "delete_error": NULL_TEXT,
        "created_at": L_TIME,
        "original_filename": "concat('f', cast(l_linenumber as string), '.pdf')",
    },
)


def with_pairs(df: DataFrame, **pairs: str) -> DataFrame:
    """Replace two-column pairs by nullable identity structs."""
    for prefix, name in pairs.items():
        df = df.withColumn(name, identity(f"{prefix}_r", f"{prefix}_v")).drop(f"{prefix}_r", f"{prefix}_v")
    return df


def design_items(spark, sf, whole: bool = False) -> DataFrame:
    return with_pairs((DESIGN_ITEMS.whole if whole else DESIGN_ITEMS).df(spark, sf), d="desired", a="analyzed", p="published")


def design_jobs(spark, sf) -> DataFrame:
    return with_pairs(DESIGN_JOBS.df(spark, sf), e="execution")
