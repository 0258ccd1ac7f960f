"""Identity state of every item, kept in the state store between micro-batches.

The observations of an item lie in slices of the state: each holds the registers before it and
its observations in ``seq`` order. A micro-batch reads, of the items it is about, only the slices its
observations fall into, and the slices after them only as long as the registers before those
change; a late observation corrects the states from the first one that it changes. Where more than two slices
and a third of all are wanted, all are read in one go. What a batch reads is therefore bounded by its own rows
and the slice size, not by the history of an item.

``item_states`` computes the same from whole histories as columns. An item's
observations are one sequence, so those of one item in one micro-batch are worked on by one task.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from worklens.streaming.events import for_each_batch
from worklens.streaming.state import KEYS, WAITING

#: Observations of one slice; one that grows to twice as many is cut.
SLICE = 256
FIELDS = ("kind", "readiness", "execution_kind", "input_revision", "pipeline_version")
STATES = (
    "board_id string, item_id string, seq long, state string, desired_input_revision string, "
    "desired_pipeline_version string, obligation string, supersession_requested boolean"
)
STATE = Row(*[c.split()[0] for c in STATES.split(", ")])
#: state, wanted, analysed, published and running identity, kind of the run, superseded.
START = ["scheduled", None, None, None, None, None, False]
FIRST = -(1 << 63)


def observed(registers: list, row: list, publication_allowed: bool) -> list:
    """The registers after one observation; identities are pairs of revision and version."""
    state, wanted, analysed, published, running, run_kind, superseded = registers
    kind, readiness, execution_kind, revision, version = row
    pair = [revision, version] if revision is not None and version is not None else None
    if kind == "snapshot":
        before, wanted = wanted, pair if readiness == "ready" and pair and revision != "" else None
        changed = wanted != before
        if readiness != "ready":
            state = readiness
        elif changed and wanted and wanted != published:
            state = "scheduled" if running is None else "publishing" if run_kind == "publication" else "processing"
        elif changed and state in WAITING:
            state = "scheduled"
        if changed and running is not None and running != wanted:
            superseded = True
    elif kind == "started":
        running, run_kind = pair, execution_kind
        state = "publishing" if execution_kind == "publication" else "processing"
    elif kind == "finished":
        if running is not None and running == wanted:
            if run_kind == "analysis":
                analysed = running
            else:
                published = running
            state = "ready_for_review" if run_kind == "publication" else "scheduled" if publication_allowed else "analyzed"
            superseded = False
        running, run_kind = None, None
    return [state, wanted, analysed, published, running, run_kind, superseded]


def shown(registers: list, publication_allowed: bool) -> tuple:
    """The columns of a state after its observation."""
    state, wanted, analysed, published, _, _, superseded = registers
    obligation = None
    if wanted is not None:
        obligation = "analysis" if wanted != analysed else "publication" if publication_allowed and wanted != published else None
    return (state, *(wanted or (None, None)), obligation, superseded)


def pages_of(pages: Any, wanted: list[int], n_pages: int) -> dict[int, tuple]:
    """All pages of a map state in one go where a third of them is wanted, else none.

    Each call of the state is a message between worker and executor; many single ones cost more than the pages.
    """
    return {key[0]: value for key, value in pages.iterator()} if len(wanted) > 2 and 3 * len(wanted) >= n_pages else {}


class ItemStates(StatefulProcessor):
    """Slices of one item as a map in the state store, and a list of where they start."""

    def __init__(self, publication_allowed: bool, keep_for_seconds: int | None, slice_size: int):
        self.allowed, self.keep_for, self.slice_size = publication_allowed, keep_for_seconds, slice_size

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.starts = handle.getValueState("starts", "starts string")
        self.slices = handle.getMapState("slices", "start long", "before string, rows string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers: Any) -> Iterator[Row]:
        # Of several observations of one place the last to come counts.
        arrived = {row.seq: [row[name] for name in FIELDS] for row in rows}
        changed = self._merged(arrived)
        if self.keep_for is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + 1000 * self.keep_for)
        for seq, registers in changed:
            yield STATE(*key, seq, *shown(registers, self.allowed))

    def handleExpiredTimer(self, key: tuple, timers: Any, expired: Any) -> Iterator[Row]:
        """An item that was silent for so long is forgotten: what comes later starts anew."""
        self.starts.clear()
        self.slices.clear()
        return iter(())

    def _merged(self, arrived: dict[int, list]) -> list[tuple[int, list]]:
        """Stores the new observations; the registers after each of them and after every one that they have changed."""
        known = self.starts.get()
        starts = json.loads(known[0]) if known else [FIRST]
        groups: dict[int, dict[int, list]] = {}
        for seq in sorted(arrived):
            groups.setdefault(bisect_right(starts, seq) - 1, {})[seq] = arrived[seq]
        read = pages_of(self.slices, [starts[i] for i in groups], len(starts)) if known else {}
        waiting, out, known_starts, carried, i = deque(sorted(groups)), [], list(starts), None, -1
        while waiting or carried is not None:
            i = i + 1 if carried is not None else waiting[0]
            if i >= len(starts):
                break
            found = (read.get(starts[i]) or self.slices.getValue((starts[i],))) if known else None
            before, rows = [json.loads(part) for part in found] if found else (START, [])
            mine = groups.get(i, {})
            if carried is not None and carried == before and not mine:
                carried = None
                continue
            if waiting and waiting[0] == i:
                waiting.popleft()
            held = dict(rows)
            merged = sorted({**held, **mine}.items())
            registers, old = before if carried is None else carried, before
            pieces, piece = [], []
            whole = len(merged) >= 2 * self.slice_size
            for seq, fields in merged:
                if not pieces or (whole and len(piece) == self.slice_size):
                    piece = []
                    pieces.append((seq if pieces else starts[i], registers, piece))
                same = registers == old
                registers = observed(registers, fields, self.allowed)
                if seq in mine:
                    old = observed(old, held[seq], self.allowed) if seq in held else old
                    out.append((seq, registers))
                else:
                    old = registers if same else observed(old, fields, self.allowed)
                    if registers != old:
                        out.append((seq, registers))
                piece.append((seq, fields))
            for start, registers_before, piece in pieces:
                self.slices.updateValue((start,), (json.dumps(registers_before), json.dumps(piece)))
            known_starts += [start for start, _, _ in pieces[1:]]
            # Where the registers are as before, the slices behind stay as they are.
            carried = None if registers == old else registers
        if len(known_starts) > len(starts) or not known:
            self.starts.update((json.dumps(sorted(known_starts)),))
        return out

    def close(self) -> None:
        pass


def keyed_item_states(
    stream: DataFrame, publication_allowed: bool = True, keep_for_seconds: int | None = None, slice_size: int = SLICE
) -> DataFrame:
    """A stream of the states that the observations of each micro-batch have set or corrected.

    Columns as ``item_states``. Observations may come in any order; one with a ``seq`` that is known replaces
    the earlier one. Without ``keep_for_seconds`` no item is ever forgotten.
    """
    processor = ItemStates(publication_allowed, keep_for_seconds, slice_size)
    mode = "None" if keep_for_seconds is None else "ProcessingTime"
    wanted = stream.select(*KEYS, F.col("seq").cast("long").alias("seq"), *FIELDS)
    return wanted.groupBy(*KEYS).transformWithState(processor, STATES, "Update", mode)


def run_keyed_item_states(
    stream: DataFrame,
    checkpoint: str,
    path: str,
    publication_allowed: bool = True,
    keep_for_seconds: int | None = None,
    slice_size: int = SLICE,
) -> StreamingQuery:
    """Writes what each micro-batch sets or corrects into a folder of its own; ``current_states`` reads the last word."""
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    # Map state needs this store; a query keeps the setting it was started with.
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        states = keyed_item_states(stream, publication_allowed, keep_for_seconds, slice_size)
        return for_each_batch(states, checkpoint, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}"), "update")
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def current_states(spark: SparkSession, path: str) -> DataFrame:
    """The state after every observation, as the last micro-batch that changed it left it."""
    names = [c.split()[0] for c in STATES.split(", ")][3:]
    rows = spark.read.schema(STATES + ", batch long").parquet(path)
    last = rows.groupBy(*KEYS, "seq").agg(F.max_by(F.struct(*names), "batch").alias("last"))
    return last.select(*KEYS, "seq", "last.*")
