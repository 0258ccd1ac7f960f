"""Operational metrics: counters, exact percentiles, ages and the metrics document."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from worklens import vocab
from worklens.functions.dates import age_seconds


def counter(df: DataFrame, value: str) -> DataFrame:
    """Rows per value, NULLs left out."""
    return df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))


def nearest_rank(df: DataFrame, value: str, percentiles: Sequence[float], keys: Sequence[str] = (), width: float = 60.0) -> DataFrame:
    """Exact nearest-rank percentiles (element ``ceil(p * n)`` of the sorted values).

    Values are counted per slice of ``width`` and per distinct value on the map
    side. Slice totals locate the slice of each rank; only that slice's distinct
    values are then sorted, so a key with any number of rows stays small.
    """
    keys = list(keys)
    counts = (
        df.filter(F.col(value).isNotNull())
        .withColumn("_slice", F.floor(F.col(value) / width))
        .groupBy(*keys, "_slice", F.col(value).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    slices = counts.groupBy(*keys, "_slice").agg(F.sum("_n").alias("_n"))
    slices = slices.withColumn("_upto", F.sum("_n").over(by_slice)).withColumn(
        "_total", F.sum("_n").over(Window.partitionBy(*keys))
    )
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in percentiles]))
    ranks = slices.withColumn("p", wanted).withColumn(
        "_rank", F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("_total")))
    )
    hit = ranks.filter((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n")))
    hit = hit.select(*keys, "_slice", "p", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"))
    inside = counts.join(hit, [*keys, "_slice"])
    running = F.sum("_n").over(Window.partitionBy(*keys, "p").orderBy("_value"))
    reached = inside.withColumn("_running", running).filter(F.col("_running") >= F.col("_rank"))
    return reached.groupBy(*keys, "p").agg(F.round(F.min("_value").cast("double"), 3).alias("value"))


def _disc(p: float, column: str) -> Column:
    # For small counters: few distinct values, so the aggregate buffer is small.
    return F.round(F.expr(f"percentile_disc({p}) within group (order by {column})").cast("double"), 3)


def _filled(pairs: Column) -> Column:
    """A map of the pairs that count something."""
    return F.map_from_entries(F.filter(pairs, lambda p: p["n"] > 0))


def operations_metrics(
    items: DataFrame,
    jobs: DataFrame,
    artifacts: DataFrame,
    dispatches: DataFrame,
    *,
    now: Column,
    lease_seconds: int = vocab.LEASE_SECONDS,
) -> DataFrame:
    """The metrics document as one row.

    Items, artifacts and dispatches are read in one pass each, jobs in a second one for the
    latency percentiles, which need their own order.
    """
    if lease_seconds < 1:
        raise ValueError("lease_seconds must be positive")

    status = F.col("status")
    active = status.isin(*vocab.ACTIVE_DESIGN_JOB_STATUSES)
    waiting = active & F.col("execution_kind").isNull() & F.coalesce(F.col("stage").isin(*vocab.READINESS_STAGES), F.lit(False))
    running = status == "running"
    beat = age_seconds(now, F.coalesce("heartbeat_at", "locked_at"))
    attempts = F.coalesce("attempt_count", F.lit(0))
    checks = F.coalesce("readiness_check_count", F.lit(0))
    staged = jobs.select(
        "status",
        waiting.alias("_waiting"),
        running.alias("_running"),
        F.when(waiting, F.coalesce(age_seconds(now, "created_at"), F.lit(0.0))).alias("_wait_age"),
        F.when(waiting, checks.cast("double")).alias("_checks"),
        attempts.cast("double").alias("_attempts"),
        F.when(running, beat).alias("_beat"),
        F.when((F.col("execution_kind") == "publication") & (status == "completed"), age_seconds(F.col("completed_at"), "started_at")).alias("_latency"),
        ((status == "cancelled") & F.col("superseded_by_revision").isNotNull()).alias("_superseded"),
    )
    job_row = staged.agg(
        F.count_if("_waiting").alias("readiness_waiting_jobs"),
        F.max("_wait_age").alias("readiness_oldest_age_seconds"),
        F.coalesce(F.sum("_checks"), F.lit(0.0)).cast("long").alias("readiness_checks_total"),
        _disc(0.95, "_checks").alias("readiness_checks_p95"),
        F.count(F.lit(1)).alias("attempts_jobs"),
        F.coalesce(F.sum("_attempts"), F.lit(0.0)).cast("long").alias("attempts_total"),
        _disc(0.5, "_attempts").alias("attempts_p50"),
        _disc(0.95, "_attempts").alias("attempts_p95"),
        F.count_if("_running").alias("leases_running"),
        F.count_if(F.col("_beat") >= lease_seconds).alias("leases_expired"),
        F.max("_beat").alias("leases_oldest_heartbeat_age_seconds"),
        F.count_if("_superseded").alias("supersessions_cancelled_jobs"),
        F.count("_latency").alias("publication_latency_count"),
        # The active statuses are a fixed vocabulary.
        _filled(F.array(*[F.struct(F.lit(s).alias("k"), F.count_if(status == s).alias("n")) for s in sorted(vocab.ACTIVE_DESIGN_JOB_STATUSES)])).alias(
            "queue_depth"
        ),
    )

    desired, analyzed, published = F.col("desired"), F.col("analyzed"), F.col("published")
    by_state = items.groupBy("state").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("supersession_requested_at").isNotNull()).alias("_pending"),
        F.count_if(desired.isNotNull() & desired.eqNullSafe(analyzed) & ~desired.eqNullSafe(published)).alias("_open"),
    )
    # One row per state, so the second step is small.
    item_row = by_state.agg(
        F.coalesce(F.sum("_pending"), F.lit(0)).alias("supersessions_pending_items"),
        F.coalesce(F.sum("_open"), F.lit(0)).alias("analyzed_not_published"),
        _filled(F.array_sort(F.collect_list(F.when(F.col("state").isNotNull(), F.struct(F.col("state").alias("k"), "n"))))).alias("items_by_state"),
    )

    to_delete = status == "delete_pending"
    artifact_row = artifacts.agg(
        F.count_if(to_delete).alias("cleanup_delete_pending"),
        F.count_if(to_delete & (F.length(F.coalesce("last_error", F.lit(""))) > 0)).alias("cleanup_delete_pending_with_errors"),
        F.count_if(status == "deleted").alias("cleanup_deleted"),
    )

    spread = nearest_rank(staged.select("_latency"), "_latency", (0.5, 0.95)).agg(
        F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("publication_latency_p50"),
        F.max(F.when(F.col("p") == 0.95, F.col("value"))).alias("publication_latency_p95"),
    )
    mine = dispatches.filter(F.col("consumer") == "design_processing").groupBy("status", "outcome").agg(F.count(F.lit(1)).alias("n"))

    def tally(column: str, name: str) -> DataFrame:
        counts = mine.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("k")).agg(F.sum("n").alias("n"))
        return counts.agg(_filled(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))

    rows = [tally("status", "dispatch_status"), tally("outcome", "dispatch_outcome"), item_row, artifact_row, spread]
    # Each part is one row with its own columns; merged, they are the document.
    parts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [job_row, *rows])
    merged = parts.agg(*[F.any_value(c, F.lit(True)).alias(c) for c in parts.columns])
    return merged.withColumn("schema_version", F.lit(1)).withColumn("collected_at", now)


def metrics_json(metrics: DataFrame) -> DataFrame:
    return metrics.select(F.to_json(F.struct(*sorted(metrics.columns))).alias("document"))


def readiness_alerts(jobs: DataFrame, now: Column, threshold: int = vocab.READINESS_ALERT_SECONDS) -> DataFrame:
    """Readiness jobs that have been waiting too long."""
    waiting = F.col("status").isin(*vocab.ACTIVE_DESIGN_JOB_STATUSES) & F.col("execution_kind").isNull() & F.col("stage").isin(*vocab.READINESS_STAGES)
    aged = jobs.filter(waiting).withColumn("readiness_age_seconds", age_seconds(now, "created_at"))
    return aged.filter(F.col("readiness_age_seconds") >= threshold)
