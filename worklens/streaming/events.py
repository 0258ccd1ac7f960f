"""The event flow as Structured Streaming, built from the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from worklens import vocab
from worklens.operators import events as ops
from worklens.session import read_if_there
from worklens.streaming.key_index import FAN, KEYS_PER_FILE, KeyIndex


def first_deliveries(stream: DataFrame, watermark: str | None = None) -> DataFrame:
    """Each idempotency key once; rows without a key are for ``ops.rejected``.

    By default every key is kept for ever and however late a row is, it counts. A
    watermark bounds the state at a price the caller must want: later rows are dropped
    and a key that returns after it counts as new. ``run_first_deliveries`` keeps the
    keys in an index instead of the state.
    """
    keyed = stream.filter("idempotency_key is not null")
    if watermark is None:
        return keyed.dropDuplicates(["idempotency_key"])
    return keyed.withWatermark("received_at", watermark).dropDuplicatesWithinWatermark(["idempotency_key"])


def batches(spark: SparkSession, path: str, schema: StructType, below: int) -> DataFrame:
    """The rows that micro-batches up to ``below`` have left under ``path``, each in a folder of its own."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
    return rows.filter(F.col("batch") <= below).drop("batch")


def run_first_deliveries(
    stream: DataFrame,
    checkpoint: str,
    path: str,
    keys_per_file: int = KEYS_PER_FILE,
    fan: int = FAN,
    order: Sequence[str] = ("received_at",),
) -> StreamingQuery:
    """First deliveries as a table, with an index of all keys beside it.

    A micro-batch writes the rows whose key no earlier batch has, into a folder of its own
    that a repeated batch replaces. No key is forgotten, no late row is dropped and no
    state is kept; ``order`` decides within a micro-batch. ``path/_keys`` holds a ``KeyIndex``: what a micro-batch reads of it depends on
    its own keys, not on how many came before; see ``key_index(...).lookups()``.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        index = key_index(batch.sparkSession, path, keys_per_file, fan)
        runs = index.runs(batch_id - 1)
        arrived = ops.first_deliveries(batch, order).persist()
        try:
            found = index.lookup(arrived.select("idempotency_key"), runs)
            new = arrived if found.known is None else arrived.join(found.known, "idempotency_key", "left_anti").select(*batch.columns)
            new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            arrived.unpersist()
        stored = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/batch={batch_id}")
        index.publish(batch_id, index.add(stored.select("idempotency_key"), batch_id, runs), found)

    return for_each_batch(stream, checkpoint, handle)


def key_index(spark: SparkSession, path: str, keys_per_file: int = KEYS_PER_FILE, fan: int = FAN) -> KeyIndex:
    """The index of the keys that ``run_first_deliveries`` has written below ``path``."""
    return KeyIndex(spark, f"{path}/_keys", "idempotency_key", keys_per_file, fan)


def run_debounce(
    stream: DataFrame, keys: list[str], checkpoint: str, path: str, gap_seconds: int = vocab.DEBOUNCE_SECONDS
) -> StreamingQuery:
    """Keeps one row per item and time slot of every micro-batch; ``bursts`` joins them.

    Slots are additive, so late events and repeated batches need no watermark: a late
    event extends or joins bursts when they are read next.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        ops.burst_slots(batch, keys, gap_seconds=gap_seconds).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return for_each_batch(stream, checkpoint, handle)


def bursts(spark: SparkSession, keys: list[str], path: str, gap_seconds: int = vocab.DEBOUNCE_SECONDS) -> DataFrame:
    """One job per burst of an item over all micro-batches so far, open bursts included."""
    return ops.merge_slots(spark.read.parquet(path).drop("batch"), keys, gap_seconds=gap_seconds)


def debounce(
    stream: DataFrame,
    keys: list[str],
    watermark: str,
    gap_seconds: int = vocab.DEBOUNCE_SECONDS,
) -> DataFrame:
    """One job per burst of an item, emitted when the burst is over, from stream state.

    The caller states how late events may come; later ones are dropped, which
    ``run_debounce`` does not do. Events exactly one gap apart still belong together.
    The session merge runs in the input tasks first when
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` is
    on, which keeps a hot item small. An event during a running job opens a new
    session instead of retargeting the job.
    """
    at = F.struct("received_at", "event_id")
    revision_at = F.when(F.col("desired_source_revision").isNotNull(), at)
    sessions = (
        stream.withWatermark("received_at", watermark)
        .groupBy(*keys, F.session_window("received_at", f"{gap_seconds} seconds").alias("burst"))
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.max(F.struct(at.alias("p"), F.col("trigger_type").alias("v"))).alias("_trigger"),
            F.max(F.struct(revision_at.alias("p"), F.col("desired_source_revision").alias("v"))).alias("_revision"),
        )
    )
    return sessions.select(
        *keys,
        F.col("burst.start").alias("first_at"),
        F.col("burst.end").alias("scheduled_for"),
        "n_events",
        F.col("_trigger.v").alias("trigger_type"),
        F.col("_revision.v").alias("desired_source_revision"),
    )


def dispatches(stream: DataFrame, watermark: str | None = None) -> DataFrame:
    """Raw events to pending dispatches: normalise, once per key, one row per consumer."""
    return ops.fan_out(first_deliveries(ops.normalize(stream), watermark))


def with_current_item(events: DataFrame, current_items: DataFrame) -> DataFrame:
    """The current item of every event; the group named by the event is ignored.

    Events out of order lead to the same decision, because only the stored state
    counts. ``current_items`` is read anew for every micro-batch.
    """
    decided = current_items.select("item_id", F.col("group_id").alias("current_group_id"), "item_state", "source_revision")
    return events.join(decided, "item_id", "left")


def run_current_items(
    stream: DataFrame, checkpoint: str, path: str, newest: Callable[[], str], items_at: Callable[[str], DataFrame]
) -> StreamingQuery:
    """The current item of every event, each micro-batch by one version of an item table that changes.

    ``newest`` names the version to use now, ``items_at`` reads one. A micro-batch notes its version before
    anything is decided, so its rows never mix two versions and a repeated batch decides as the first attempt
    did. ``path`` gets the rows with ``item_version``; ``path/_versions`` the version of each batch.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        note = f"{path}/_versions/batch={batch_id}"
        known = read_if_there(spark, note)
        if known is None:
            spark.createDataFrame([(newest(),)], "version string").coalesce(1).write.mode("overwrite").parquet(note)
            known = spark.read.parquet(note)
        version = known.first()["version"]
        decided = with_current_item(batch, items_at(version)).withColumn("item_version", F.lit(version))
        decided.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return for_each_batch(stream, checkpoint, handle)


def run_available(
    stream: DataFrame, checkpoint: str, path: str, mode: str = "append"
) -> StreamingQuery:
    """Write everything that has arrived so far and stop."""
    return (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start(path)
    )


def for_each_batch(
    stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append"
) -> StreamingQuery:
    """Run batch plans on every micro-batch; the handler must tolerate a repeated batch id."""
    return (
        stream.writeStream.foreachBatch(handle)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
