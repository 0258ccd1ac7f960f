"""Identity state of every item after each of its observations, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from worklens.streaming.events import batches, for_each_batch

#: States that a changed, already published revision leaves again.
WAITING = ("waiting_for_name", "waiting_for_email", "ineligible", "failed")
KEYS = ["board_id", "item_id"]


def item_states(observations: DataFrame, publication_allowed: bool = True) -> DataFrame:
    """State after every observation of an item, in ``seq`` order.

    observations: board_id, item_id, seq, kind ('snapshot' | 'started' |
    'finished'), readiness, execution_kind, input_revision, pipeline_version.

    Every register of an item is the last value that some row gave it, so each is
    one running window: the wanted identity comes from the last snapshot, the
    running one from the last start or end, analysed and published ones from the
    last end that matched what was wanted. Nothing depends on how rows arrive; rows
    of an item are sorted on disk if need be and none is kept in memory.
    """
    order = Window.partitionBy(*KEYS).orderBy("seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)

    def last(c: Column, window=so_far) -> Column:
        return F.last(c, ignorenulls=True).over(window)

    pair = F.struct(F.col("input_revision").alias("revision"), F.col("pipeline_version").alias("version"))
    snapshot, started, finished = (F.col("kind") == k for k in ("snapshot", "started", "finished"))
    whole = F.col("input_revision").isNotNull() & F.col("pipeline_version").isNotNull()
    wanted = F.when((F.col("readiness") == "ready") & (F.col("input_revision") != "") & whole, pair)
    # A struct around the value tells "set to nothing" from "not set by this row".
    rows = observations.withColumns(
        {
            "_wanted": F.when(snapshot, F.struct(wanted.alias("v"))),
            "_run": F.when(started, F.struct(F.when(whole, pair).alias("v"), F.col("execution_kind").alias("k"))).when(
                finished, F.struct(F.lit(None).cast("struct<revision:string,version:string>").alias("v"), F.lit(None).cast("string").alias("k"))
            ),
        }
    )
    rows = rows.withColumns(
        {
            "_desired": last(F.col("_wanted"))["v"],
            "_desired_before": last(F.col("_wanted"), before)["v"],
            "_running": last(F.col("_run"), before)["v"],
            "_running_kind": last(F.col("_run"), before)["k"],
        }
    )
    done = finished & F.col("_running").isNotNull() & F.coalesce(F.col("_running") == F.col("_desired_before"), F.lit(False))
    publication = F.coalesce(F.col("_running_kind") == "publication", F.lit(False))
    analysis = F.coalesce(F.col("_running_kind") == "analysis", F.lit(False))
    rows = rows.withColumns(
        {
            "_done": done,
            "_analyzed": last(F.when(done & analysis, F.col("_running"))),
            "_published": last(F.when(done & ~analysis, F.col("_running"))),
            "_changed": snapshot & ~F.col("_desired").eqNullSafe(F.col("_desired_before")),
        }
    )
    active = F.when(F.col("_running").isNull(), F.lit("scheduled")).when(publication, F.lit("publishing")).otherwise("processing")
    due = F.col("_changed") & F.col("_desired").isNotNull() & ~F.col("_desired").eqNullSafe(F.col("_published"))
    ready = F.col("readiness").eqNullSafe("ready")
    finish = F.when(publication, F.lit("ready_for_review")).otherwise("scheduled" if publication_allowed else "analyzed")
    given = (
        F.when(snapshot & ~ready, F.struct(F.col("readiness").alias("v")))
        .when(snapshot & due, F.struct(active.alias("v")))
        .when(started, F.struct(F.when(F.col("execution_kind") == "publication", F.lit("publishing")).otherwise("processing").alias("v")))
        .when(F.col("_done"), F.struct(finish.alias("v")))
    )
    # A change to a revision that is published already only ends a waiting state.
    ends_waiting = snapshot & ready & F.col("_changed") & ~due
    overtaken = F.col("_changed") & F.col("_running").isNotNull() & ~F.col("_running").eqNullSafe(F.col("_desired"))
    rows = rows.withColumns(
        {
            "_given": given,
            "_superseded": last(F.when(overtaken, F.lit(True)).when(F.col("_done"), F.lit(False))),
            "_ends": ends_waiting,
        }
    )
    rows = rows.withColumns(
        {
            "_state": F.coalesce(last(F.col("_given")), F.struct(F.lit("scheduled").alias("v")))["v"],
            "_given_at": F.coalesce(F.max(F.when(F.col("_given").isNotNull(), F.col("seq"))).over(so_far), F.lit(-1)),
            "_ended_at": F.max(F.when(F.col("_ends"), F.col("seq"))).over(so_far),
        }
    )
    left = F.col("_state").isin(*WAITING) & F.coalesce(F.col("_ended_at") > F.col("_given_at"), F.lit(False))
    obligation = (
        F.when(F.col("_desired").isNull(), F.lit(None))
        .when(~F.col("_desired").eqNullSafe(F.col("_analyzed")), F.lit("analysis"))
        .when(F.lit(publication_allowed) & ~F.col("_desired").eqNullSafe(F.col("_published")), F.lit("publication"))
    )
    return rows.select(
        *KEYS,
        "seq",
        F.when(left, F.lit("scheduled")).otherwise(F.col("_state")).alias("state"),
        F.col("_desired.revision").alias("desired_input_revision"),
        F.col("_desired.version").alias("desired_pipeline_version"),
        obligation.alias("obligation"),
        F.coalesce("_superseded", F.lit(False)).alias("supersession_requested"),
    )


def run_item_states(stream: DataFrame, checkpoint: str, path: str, publication_allowed: bool = True):
    """Keeps the observations of every micro-batch and the states of the items that it touched.

    ``path/observations`` grows by one folder per micro-batch, ``path/states`` holds for
    each micro-batch all states of its items as known then; a late observation corrects
    the states after it. A repeated batch replaces its folders.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/observations/batch={batch_id}")
        touched = spark.read.schema(batch.schema).parquet(f"{path}/observations/batch={batch_id}").select(*KEYS).distinct()
        known = batches(spark, f"{path}/observations", batch.schema, batch_id)
        states = item_states(known.join(touched, KEYS, "left_semi"), publication_allowed)
        states.write.mode("overwrite").parquet(f"{path}/states/batch={batch_id}")

    return for_each_batch(stream, checkpoint, handle)
