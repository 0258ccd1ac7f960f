"""Change events: normalise, key, de-duplicate, fan out, debounce, roll up."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from worklens import vocab
from worklens.functions.text import blank_to_null, col
from worklens.scale import keep_first


@F.pandas_udf(T.StringType())
def canonical_json_hash(payload: pd.Series, wanted: pd.Series) -> pd.Series:
    """SHA-256 of the sorted, compact, ASCII-escaped JSON where it is wanted, else an empty text.

    NULL for missing payloads and for those that are not one JSON value: the one place that decides
    what is readable. Repeated members and NaN are, text after the value is not.
    """

    def one(text: str | None, hashed: bool) -> str | None:
        if text is None:
            return None
        try:
            value = json.loads(text)
            if not hashed:
                return ""
            encoded = json.dumps(value, sort_keys=True, separators=(",", ":"))
        except (ValueError, RecursionError):
            return None
        return hashlib.sha256(encoded.encode("utf-8")).hexdigest()

    return pd.Series([one(p, h) for p, h in zip(payload, wanted)], dtype=object)


def normalize(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds the normalised fields and the idempotency key of every raw payload.

    The body is the ``event`` member when that is an object, else the payload.
    Only payloads without ids are hashed. Columns of
    ``events`` with the name of an added one are replaced. A payload that is no JSON
    has neither fields nor a key: see ``rejected``. One that holds NaN has no fields either; it is
    a delivery whose key is its hash.
    """
    added = [*vocab.EVENT_ALIASES, "idempotency_key"]
    if payload in added:
        raise ValueError(f"the payload column may not be named {payload}")
    events = events.drop(*added)
    inner = F.get_json_object(col(payload), "$.event")
    # A text that opens with a brace looks like an object; its JSON type tells them apart.
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(col(payload)), "$.event", "variant"))
    is_object = F.when(inner.startswith("{"), F.coalesce(kind.startswith("OBJECT"), F.lit(False))).otherwise(F.lit(False))
    body = F.when(is_object, inner).otherwise(col(payload))
    # One parse of the body yields every alias.
    aliases = [alias for names in vocab.EVENT_ALIASES.values() for alias in names]
    raw = [f"_{alias}" for alias in aliases]
    staged = events.withColumn("_body", body)
    staged = staged.select("*", F.json_tuple("_body", *aliases).alias(*raw)).drop("_body")
    fields = {
        name: F.coalesce(*[blank_to_null(f"_{alias}") for alias in names])
        for name, names in vocab.EVENT_ALIASES.items()
    }
    staged = staged.select(*events.columns, *[c.alias(n) for n, c in fields.items()])
    by_trigger = F.col("trigger_uuid").isNotNull()
    by_event = F.col("event_id").isNotNull() & F.col("subscription_id").isNotNull()
    # NULL where the payload is unreadable: then there are neither fields nor a key.
    staged = staged.withColumn("_hash", canonical_json_hash(col(payload), ~by_trigger & ~by_event))
    readable = F.col("_hash").isNotNull()
    staged = staged.withColumns({name: F.when(readable, F.col(name)) for name in fields})
    addressed = F.col("board_id").isNotNull() & F.col("item_id").isNotNull() & F.col("event_type").isNotNull()
    key = (
        F.when(~readable, F.lit(None).cast("string"))
        .when(by_trigger, F.concat(F.lit("trigger:"), F.col("trigger_uuid")))
        .when(by_event, F.concat(F.lit("event:"), F.col("subscription_id"), F.lit(":"), F.col("event_id")))
        .when(
            addressed,
            F.concat(
                F.lit("payload:"),
                F.col("board_id"),
                F.lit(":"),
                F.col("item_id"),
                F.lit(":"),
                F.col("event_type"),
                F.lit(":"),
                F.col("_hash"),
            ),
        )
        .otherwise(F.concat(F.lit("payload:"), F.col("_hash")))
    )
    return staged.withColumn("idempotency_key", key).drop("_hash")


def trigger_type(event_type: Column | str, column_id: Column | str) -> Column:
    """What a change event asks the design processing to do; NULL when nothing."""
    kind = F.lower(F.trim(F.coalesce(col(event_type), F.lit(""))))
    column = F.trim(F.coalesce(col(column_id), F.lit("")))
    return (
        F.when(column.isin(*vocab.OUTPUT_COLUMNS), F.lit(None).cast("string"))
        .when(kind.isin(*vocab.CREATE_EVENT_TYPES), F.lit("webhook_create"))
        .when(kind.isin(*vocab.MOVE_EVENT_TYPES), F.lit("webhook_move"))
        .when(column == vocab.EMAIL_COLUMN, F.lit("webhook_email"))
        .when((column == "name") | kind.isin(*vocab.NAME_EVENT_TYPES), F.lit("webhook_name"))
    )


def rejected(events: DataFrame, payload: str = "payload") -> DataFrame:
    """The rows whose payload is missing or no JSON, as they came, with the reason.

    They have no idempotency key and are no deliveries; works on a stream as well.
    """
    readable = canonical_json_hash(col(payload), F.lit(False)).isNotNull()
    reason = F.when(col(payload).isNull(), F.lit("missing")).when(~readable, F.lit("unreadable"))
    return events.withColumn("reject_reason", reason).filter("reject_reason is not null")


def first_deliveries(events: DataFrame, order: Sequence[str] = ("received_at",)) -> DataFrame:
    """One row per idempotency key: the first delivery. Rows without a key are left to ``rejected``."""
    return keep_first(events.filter("idempotency_key is not null"), ["idempotency_key"], [F.col(c) for c in order])


def fan_out(events: DataFrame) -> DataFrame:
    """One pending dispatch per event and consumer."""
    consumers = F.explode(F.array(*[F.lit(c) for c in vocab.DISPATCH_CONSUMERS]))
    return events.withColumn("consumer", consumers).withColumn("status", F.lit("pending"))


def is_retryable(result_json: Column | str) -> Column:
    """A failed dispatch may run again unless its result says otherwise."""
    has_flag = F.coalesce(F.array_contains(F.json_object_keys(col(result_json)), "retryable"), F.lit(False))
    flag = F.get_json_object(col(result_json), "$.retryable")
    return ~has_flag | F.coalesce(~flag.isin("false", "0", "", "[]", "{}"), F.lit(False))


def is_stale(started_at: Column | str, now: Column, lease_seconds: int = vocab.EVENT_LEASE_SECONDS) -> Column:
    started = col(started_at).cast("timestamp")
    return started.isNull() | (started <= now - F.make_dt_interval(secs=F.lit(lease_seconds)))


def claimable_dispatches(dispatches: DataFrame, now: Column) -> DataFrame:
    """Dispatches a worker may take: pending, stale in progress, or failed and retryable."""
    take = (
        (F.col("status") == "pending")
        | ((F.col("status") == "processing") & is_stale("processing_started_at", now))
        | ((F.col("status") == "failed") & is_retryable("result_json"))
    )
    return dispatches.filter(take)


def claim_events(deliveries: DataFrame, stored: DataFrame, dispatches: DataFrame, now: Column) -> DataFrame:
    """Decision per delivery: ``new``, ``reclaimed`` or ``duplicate``.

    A stored event runs again when it was only received, when its lease went
    stale, or when it failed and has no dispatch at all or a claimable one.
    """
    retry = dispatches.groupBy("event_id").agg(F.count(F.lit(1)).alias("_dispatches"))
    open_work = claimable_dispatches(dispatches, now).select("event_id").distinct().withColumn("_open", F.lit(True))
    known = (
        stored.select("event_id", "idempotency_key", "status", "processing_started_at")
        .join(retry, "event_id", "left")
        .join(open_work, "event_id", "left")
        .select(
            "idempotency_key",
            (
                (F.col("status") == "received")
                | ((F.col("status") == "processing") & is_stale("processing_started_at", now))
                | (
                    F.col("status").isin("failed", "partial_failed")
                    & (F.col("_dispatches").isNull() | F.coalesce(F.col("_open"), F.lit(False)))
                )
            ).alias("_again"),
        )
    )
    joined = first_deliveries(deliveries).join(known, "idempotency_key", "left")
    decision = (
        F.when(F.col("_again").isNull(), F.lit("new")).when(F.col("_again"), F.lit("reclaimed")).otherwise("duplicate")
    )
    return joined.withColumn("claim", decision).drop("_again")


def debounce(
    events: DataFrame,
    keys: Sequence[str],
    at: str = "received_at",
    trigger: str = "trigger_type",
    revision: str = "desired_source_revision",
    tie: str = "event_id",
    gap_seconds: int = vocab.DEBOUNCE_SECONDS,
) -> DataFrame:
    """One job per burst: events of a key at most ``gap_seconds`` apart belong together.

    Events in the same gap-wide time slot always belong together, so each key is
    first reduced to one row per slot on the map side. Only slots - bounded by
    the time span, not by the event count - reach the window that joins
    neighbouring slots, which keeps a hot key small.
    """
    return merge_slots(burst_slots(events, keys, at, trigger, revision, tie, gap_seconds), keys, trigger, revision, gap_seconds)


def burst_slots(
    events: DataFrame,
    keys: Sequence[str],
    at: str = "received_at",
    trigger: str = "trigger_type",
    revision: str = "desired_source_revision",
    tie: str = "event_id",
    gap_seconds: int = vocab.DEBOUNCE_SECONDS,
) -> DataFrame:
    """One additive row per key and gap-wide time slot."""
    slot = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (gap_seconds * 1_000_000))
    position = F.struct(F.col(at).cast("timestamp").alias("t"), F.col(tie).alias("e"))
    return events.groupBy(*keys, slot.alias("_slot")).agg(
        F.min(F.col(at).cast("timestamp")).alias("_first"),
        F.max(F.col(at).cast("timestamp")).alias("_last"),
        F.count(F.lit(1)).alias("_n"),
        F.max(F.struct(position.alias("p"), F.col(trigger).alias("v"))).alias("_trigger"),
        F.max(F.when(F.col(revision).isNotNull(), F.struct(position.alias("p"), F.col(revision).alias("v")))).alias(
            "_revision"
        ),
    )


def merge_slots(
    slots: DataFrame,
    keys: Sequence[str],
    trigger: str = "trigger_type",
    revision: str = "desired_source_revision",
    gap_seconds: int = vocab.DEBOUNCE_SECONDS,
) -> DataFrame:
    """Bursts from slot rows; a slot may have several rows, from several micro-batches."""
    slots = slots.groupBy(*keys, "_slot").agg(
        F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
        F.sum("_n").alias("_n"),
        F.max("_trigger").alias("_trigger"),
        F.max("_revision").alias("_revision"),
    )
    ordered = Window.partitionBy(*keys).orderBy("_slot")
    gap = F.unix_micros("_first") - F.unix_micros(F.lag("_last").over(ordered))
    starts = F.coalesce((gap > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    bursts = slots.withColumn("_start", starts).withColumn("_burst", F.sum("_start").over(ordered))
    merged = bursts.groupBy(*keys, "_burst").agg(
        F.min("_first").alias("first_at"),
        F.max("_last").alias("last_at"),
        F.sum("_n").alias("n_events"),
        F.max("_trigger").alias("_trigger"),
        F.max("_revision").alias("_revision"),
    )
    return merged.select(
        *keys,
        "first_at",
        "last_at",
        "n_events",
        F.col("_trigger.v").alias(trigger),
        F.col("_revision.v").alias(revision),
        (F.col("last_at") + F.make_dt_interval(secs=F.lit(gap_seconds))).alias("scheduled_for"),
    )


def parent_status(dispatches: DataFrame, key: str = "event_id") -> DataFrame:
    """Event status and error text rolled up from its dispatches."""
    status = F.col("status")
    grouped = dispatches.groupBy(key).agg(
        F.bool_and(status == "succeeded").alias("_all_ok"),
        F.bool_and(status == "failed").alias("_all_failed"),
        F.bool_or(status.isin("pending", "processing")).alias("_open"),
        F.bool_or(status == "failed").alias("_failed"),
        F.bool_or(status == "succeeded").alias("_ok"),
        F.array_join(F.array_sort(F.collect_set(F.when(status == "failed", F.col("consumer")))), ", ").alias("_names"),
    )
    rolled = (
        F.when(F.col("_all_ok"), F.lit("completed"))
        .when(F.col("_all_failed"), F.lit("failed"))
        .when(F.col("_open"), F.lit("processing"))
        .when(F.col("_failed") & F.col("_ok"), F.lit("partial_failed"))
        .otherwise("processing")
    )
    error = F.when(F.col("_failed"), F.concat(F.lit("failed consumers: "), F.col("_names")))
    return grouped.select(key, rolled.alias("event_status"), error.alias("error"))


def roll_up_events(events: DataFrame, dispatches: DataFrame, key: str = "event_id") -> DataFrame:
    """All events with their rolled-up status; an event without dispatches is processing."""
    rolled = events.select(key).join(parent_status(dispatches, key), key, "left")
    return rolled.withColumn("event_status", F.coalesce("event_status", F.lit("processing")))


def response_status(dispatches: DataFrame, key: str = "event_id") -> DataFrame:
    """Answer text of an event from the outcomes of its two consumers."""

    def of(consumer: str, column: str) -> Column:
        return F.max(F.when(F.col("consumer") == consumer, F.col(column)))

    outcomes = dispatches.groupBy(key).agg(
        of("auto_sync", "outcome").alias("_auto"),
        of("design_processing", "outcome").alias("_design"),
        of("auto_sync", "reason").alias("_reason"),
    )
    joined = parent_status(dispatches, key).join(outcomes, key)
    status = (
        F.when(F.col("event_status").isin("failed", "partial_failed", "processing"), F.col("event_status"))
        .when(F.col("_auto").isin("queued", "coalesced"), F.lit("queued"))
        .when(F.col("_design").isin("queued", "coalesced"), F.lit("queued"))
        .when(F.col("_reason") == "completed_retention_only", F.lit("retained"))
        .when(F.col("_auto") == "excluded", F.lit("cancelled"))
        .otherwise("ignored")
    )
    return joined.select(key, status.alias("response_status"))


def log_line(event: str, at: Column, fields: dict[str, Column]) -> Column:
    """One structured log line: a fixed prefix and canonical JSON (sorted keys, NULLs kept)."""
    members = {"event": F.lit(event), "timestamp": at.cast("string"), **fields}
    struct = F.struct(*[members[name].alias(name) for name in sorted(members)])
    return F.concat(F.lit(vocab.EVENT_LOG_PREFIX), F.to_json(struct, {"ignoreNullFields": "false"}))


def read_log(lines: DataFrame, schema: str, line: str = "value") -> DataFrame:
    """Parse structured log lines; other lines are skipped."""
    text = F.regexp_extract(F.col(line), vocab.EVENT_LOG_PREFIX + r"(\{.*\})", 1)
    return lines.select(F.from_json(text, schema).alias("e")).filter("e is not null").select("e.*")
