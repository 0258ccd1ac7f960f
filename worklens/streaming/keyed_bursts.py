"""Bursts of events per item, joined at the edges that new events touch.

The bursts of an item lie in pages of the state store, ordered by their beginning; a list says where pages
start. A micro-batch reads the pages around its own events, joins what now stands no more than the gap
apart, and hands on only the bursts that it has made, changed or taken away, so neither its
reading nor its writing grows with the history of an item. Events may come however late.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from worklens import vocab
from worklens.streaming.events import for_each_batch
from worklens.streaming.keyed_state import pages_of

#: Bursts of one page; one that grows to twice as many is cut.
PAGE = 256
#: New events of an item that are joined at a time.
JOINED_AT_ONCE = 10_000
FIRST = -(1 << 63)
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _later(x: list | None, y: list | None) -> list | None:
    """The later of two (time, tie, value), missing ones first."""
    if x is None or y is None:
        return x if y is None else y
    return max(x, y, key=lambda v: [(part is not None, part) for part in v])


def joined(bursts: list[list], gap: int) -> list[list]:
    """Bursts in order of their beginning, those no more than the gap apart as one.

    A burst is [first, last, events, trigger, revision], the last two with time and tie.
    """
    out: list[list] = []
    for first, last, n, trigger, revision in sorted(bursts, key=lambda b: b[0]):
        if out and first - out[-1][1] <= gap:
            held = out[-1]
            out[-1] = [held[0], max(held[1], last), held[2] + n, _later(held[3], trigger), _later(held[4], revision)]
        else:
            out.append([first, last, n, trigger, revision])
    return out


class ItemBursts(StatefulProcessor):
    """Pages of the bursts of one item, and the list of where they start."""

    def __init__(self, gap: int, page: int, columns: list[str]):
        self.gap, self.page, self.columns = gap, page, columns

    def init(self, handle: Any) -> None:
        self.starts = handle.getValueState("starts", "starts string")
        self.pages = handle.getMapState("pages", "start long", "bursts string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers: Any) -> Iterator[Row]:
        shown = Row(*self.columns)
        new: list[list] = []
        for part in iter(lambda: list(islice(rows, JOINED_AT_ONCE)), []):
            for row in part:
                at, tie, revision = row["at"], row["tie"], row["revision"]
                new.append([at, at, 1, [at, tie, row["trigger"]], None if revision is None else [at, tie, revision]])
            new = joined(new, self.gap)
        for first, last, n, trigger, revision, gone in self._merged(new):
            yield shown(*key, first, last, n, trigger[2], revision and revision[2], gone)

    def _merged(self, new: list[list]) -> list[list]:
        held = self.starts.get()
        starts = json.loads(held[0]) if held else [FIRST]
        known = list(starts)
        pages: dict[int, list[list]] = {}
        wanted = {bisect_right(starts, burst[0]) - 1 for burst in new}
        read = pages_of(self.pages, [starts[i] for i in wanted], len(starts)) if held else {}

        def page(i: int) -> list[list]:
            if starts[i] not in pages:
                found = (read.get(starts[i]) or self.pages.getValue((starts[i],))) if held else None
                pages[starts[i]] = json.loads(found[0]) if found else []
            return pages[starts[i]]

        changed: set[int] = set()
        made: dict[int, list] = {}
        gone: dict[int, list] = {}
        for burst in new:
            # Back to the page that holds what begins before, on while pages begin within reach.
            low = bisect_right(starts, burst[0]) - 1
            while low > 0 and not any(b[0] <= burst[0] for b in page(low)):
                low -= 1
            high = bisect_right(starts, burst[1] + self.gap)
            near = [(i, b) for i in range(low, high) for b in page(i) if b[0] <= burst[1] + self.gap and b[1] >= burst[0] - self.gap]
            whole = joined([burst, *[b for _, b in near]], self.gap)[0]
            for i, b in near:
                page(i).remove(b)
                changed.add(starts[i])
                made.pop(b[0], None)
                gone[b[0]] = b
            at = bisect_right(starts, whole[0]) - 1
            home = page(at)
            changed.add(starts[at])
            home.insert(bisect_right([b[0] for b in home], whole[0]), whole)
            made[whole[0]] = whole
        for start, bursts in [(start, bursts) for start, bursts in pages.items() if start in changed]:
            if len(bursts) >= 2 * self.page:
                pieces = [bursts[i : i + self.page] for i in range(0, len(bursts), self.page)]
                known += [piece[0][0] for piece in pieces[1:]]
                for at, piece in zip([start, *[p[0][0] for p in pieces[1:]]], pieces):
                    self.pages.updateValue((at,), (json.dumps(piece),))
            elif bursts or start == FIRST:
                self.pages.updateValue((start,), (json.dumps(bursts),))
            else:
                # A page that has a start has been written.
                known.remove(start)
                self.pages.removeKey((start,))
        if known != starts or not held:
            self.starts.update((json.dumps(sorted(known)),))
        return [[*b, False] for b in made.values()] + [[*b, True] for first, b in gone.items() if first not in made]

    def close(self) -> None:
        pass


def run_keyed_bursts(
    stream: DataFrame,
    keys: list[str],
    checkpoint: str,
    path: str,
    gap_seconds: int = vocab.DEBOUNCE_SECONDS,
    page: int = PAGE,
) -> StreamingQuery:
    """Writes the bursts that each micro-batch makes, changes or takes away; ``current_bursts`` reads those that stand.

    stream: the keys, received_at, event_id, trigger_type, desired_source_revision. Events exactly one gap apart
    belong together. What an item gets in one micro-batch is worked on by one task.
    """
    spark = stream.sparkSession
    at = F.unix_micros(F.col("received_at").cast("timestamp")).alias("at")
    rows = stream.select(
        *keys, at, F.col("event_id").alias("tie"), F.col("trigger_type").alias("trigger"), F.col("desired_source_revision").alias("revision")
    )
    added = "first_at long, last_at long, n_events long, trigger_type string, desired_source_revision string, gone boolean"
    schema = T.StructType([*[stream.schema[k] for k in keys], *T.StructType.fromDDL(added).fields])
    processor = ItemBursts(gap_seconds * 1_000_000, page, schema.names)
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    # Map state needs this store; a query keeps the setting it was started with.
    spark.conf.set(setting, STORE)
    try:
        bursts = rows.groupBy(*keys).transformWithState(processor, schema, "Update", "None")
        return for_each_batch(bursts, checkpoint, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}"), "update")
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def current_bursts(spark: SparkSession, keys: list[str], path: str, gap_seconds: int = vocab.DEBOUNCE_SECONDS) -> DataFrame:
    """One job per burst of an item that stands after all micro-batches, open bursts included."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "first_at", "batch")]
    last = rows.groupBy(*keys, "first_at").agg(F.max_by(F.struct(*values), "batch").alias("last"))
    standing = last.select(*keys, F.timestamp_micros("first_at").alias("first_at"), "last.*").filter(~F.col("gone")).drop("gone")
    standing = standing.withColumn("last_at", F.timestamp_micros("last_at"))
    return standing.withColumn("scheduled_for", F.col("last_at") + F.make_dt_interval(secs=F.lit(gap_seconds)))
