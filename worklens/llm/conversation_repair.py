"""Cheapest repair of the message order of conversations, ties by the least audit text.

Roles count by their initial. A repaired conversation is empty, or an optional system
message and then user and assistant messages in turn. Blank and duplicate messages must
be deleted (3); others are kept (0), given the role user or assistant (2) or deleted;
empty user or assistant messages can be inserted anywhere (2); a truncated message that
stays costs 1 more. The audit holds the initials of the edits (Delete, Insert, Keep,
Rerole) in order; of all cheapest audits the least in ASCII order counts.

A conversation is cut into segments of ``SEGMENT`` messages, so one that holds a large
share of all rows is worked on in parallel: min-plus products give the cost over each
segment, one pass per conversation over its segments (16 numbers each) gives the costs to
the end, and each segment then finds its least path for every state in which it can begin.

Null roles and texts count as one space, null conversation ids are one conversation, null
turns come first; rows of the same turn are ordered by role and text. Repeated rows are
duplicates. Empty tables give empty results. Other columns take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from worklens.scale import number_rows
from worklens.session import written

SEGMENT = 512
#: States: nothing yet, after a system, a user and an assistant message. Where an inserted message leads from each.
INSERTED = np.array([2, 2, 3, 2])
FAR = 1 << 40
WHITE = " \t\n\x0b\x0c\r"
SYSTEM, USER, ASSISTANT, OTHER = range(4)
GONE, CUT = 4, 8
#: Letters of the edits in ASCII order, as numbers from 1 on.
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
#: Nodes worked on at once.
NODES = 1 << 19


class Repair(NamedTuple):
    """What a repair of conversations results in.

    edits: conv, position, turn, fault, edit (letters), messages (array of role and text).
    summary: conv, gaps, blank, duplicate, truncated, illegal, cost.
    """

    edits: DataFrame
    summary: DataFrame


def _arc_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets (-1: none) and costs of deleting, keeping and reroling by code and state, and the steps with insertions before."""
    target = np.full((16, 3, 4), -1)
    cost = np.full((16, 3, 4), FAR)
    for code in range(16):
        role, gone, cut = code & 3, bool(code & GONE), int(bool(code & CUT))
        for state in range(4):
            target[code, 0, state], cost[code, 0, state] = state, 3
            if gone:
                continue
            kept = {SYSTEM: 1 if state == 0 else -1, USER: 2 if state != 2 else -1, ASSISTANT: 3 if state == 2 else -1, OTHER: -1}[role]
            if kept >= 0:
                target[code, 1, state], cost[code, 1, state] = kept, cut
            target[code, 2, state], cost[code, 2, state] = INSERTED[state], 2 + cut
    step = np.full((16, 4, 4), FAR)
    for state in range(4):
        at = state
        for inserts in range(3):
            for code in range(16):
                for arc in range(3):
                    if target[code, arc, at] >= 0:
                        to = target[code, arc, at]
                        step[code, state, to] = min(step[code, state, to], 2 * inserts + cost[code, arc, at])
            at = INSERTED[at]
    return target, cost, step


TARGET, COST, STEP = _arc_tables()
#: Costs from each state to an accepted end, insertions included.
ACCEPTED = np.array([0, 4, 2, 0], dtype=np.int64)


def segment_costs(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Least costs from each state before to each state after, for every padded row of codes."""
    total = np.where(np.eye(4, dtype=bool), 0, FAR)[None].repeat(len(codes), axis=0)
    for i in range(codes.shape[1]):
        on = np.flatnonzero(sizes > i)
        total[on] = np.minimum(FAR, (total[on][:, :, :, None] + STEP[codes[on, i]][:, None, :, :]).min(axis=2))
    return total


def least_paths(codes: np.ndarray, sizes: np.ndarray, ends: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps and end states of the least cheapest audit from each of the four states before every padded row of codes.

    ``ends`` are the costs from the states after a row of codes; insertions after its last
    message are part of it only where ``last`` is set. A step is the edit of a message (1
    delete, 2 keep, 3 rerole, 0 none) + 4 x insertions before it + 16 x state before.
    """
    rows, width = codes.shape
    worth = np.empty((width + 1, rows, 4), dtype=np.int64)
    worth[width] = ends
    for i in range(width - 1, -1, -1):
        worth[i] = worth[i + 1]
        on = np.flatnonzero(sizes > i)
        worth[i, on] = np.minimum(FAR, (STEP[codes[on, i]] + worth[i + 1, on][:, None, :]).min(axis=2))
    worth = worth.transpose(1, 0, 2)

    # Nodes are (row of codes, place, state); arcs of a node bear different letters.
    place = np.arange(width + 1)[None, :]
    inside = place < sizes[:, None]
    at_end = place == sizes[:, None]
    base = (np.arange(rows)[:, None] * (width + 1) + place) * 4
    arcs = np.full((rows, width + 1, 4, 4), -1, dtype=np.int64)
    padded = np.concatenate((codes, np.zeros((rows, 1), codes.dtype)), axis=1)
    following = np.concatenate((worth[:, 1:], worth[:, -1:]), axis=1)
    for state in range(4):
        here = worth[:, :, state]
        usable = here < FAR
        inserted = INSERTED[state]
        more = (worth[:, :, inserted] + 2 == here) & usable & (inside | (at_end & last[:, None] & (here > 0)))
        arcs[:, :, state, INSERT - 1] = np.where(more, base + inserted, -1)
        for arc, letter in ((0, DELETE), (1, KEEP), (2, REROLE)):
            to, cost = TARGET[padded, arc, state], COST[padded, arc, state]
            reached = np.take_along_axis(following, np.maximum(to, 0)[:, :, None], axis=2)[:, :, 0]
            fits = inside & usable & (to >= 0) & (reached + cost == here)
            arcs[:, :, state, letter - 1] = np.where(fits, base + 4 + to, -1)
    arcs = arcs.reshape(-1, 4)
    nodes = np.arange(len(arcs))
    starts = (np.arange(rows)[:, None] * (width + 1) * 4 + np.arange(4)[None, :]).ravel()

    # Ranks of the nodes by the first 1, 2, 4, ... letters of their least audits, with pointers to where those lead.
    ended = (arcs < 0).all(axis=1)
    first = np.argmax(arcs >= 0, axis=1)
    rank = np.where(ended, 0, first + 1)
    pointers = [np.where(ended, nodes, arcs[nodes, first])]
    while not ended[pointers[-1][starts]].all():
        jump = pointers[-1]
        rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)[1]
        pointers.append(jump[jump])
    # The arc of least letter and then least rank of what follows.
    choice = np.where(arcs >= 0, np.arange(1, 5) * (rank.max() + 1) + rank[arcs], FAR)
    letters = np.where(ended, 0, choice.argmin(axis=1) + 1)

    path = starts[:, None]
    for jump in pointers:
        path = np.concatenate((path, jump[path]), axis=1)
    letters, at = letters[path], path // 4 % (width + 1)
    state = path % 4
    steps = np.zeros((len(starts), width + 1), dtype=np.int16)
    line = np.repeat(np.arange(len(starts)), path.shape[1])
    flat, spot = letters.ravel(), at.ravel()
    inserts = flat == INSERT
    np.add.at(steps, (line[inserts], spot[inserts]), 4)
    arrived = np.zeros_like(path, dtype=bool)
    arrived[:, 0] = True
    arrived[:, 1:] = at[:, 1:] != at[:, :-1]
    arrived = arrived.ravel()
    steps[line[arrived], spot[arrived]] += (16 * state.ravel()[arrived]).astype(np.int16)
    edit = np.isin(flat, (DELETE, KEEP, REROLE))
    steps[line[edit], spot[edit]] += np.array([0, 1, 0, 2, 3], dtype=np.int16)[flat[edit]]
    final = path[:, -1] % 4
    return steps.reshape(rows, 4, width + 1), final.reshape(rows, 4)


def _padded(codes: pa.Array, most_nodes: int = NODES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, codes, sizes) of groups of similar length, each of bounded size once padded."""
    offsets = np.asarray(codes.offsets).astype(np.int64)
    flat = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes, offsets = np.diff(offsets), offsets - offsets[0]
    order = np.argsort(sizes, kind="stable")
    width = 0
    while len(order):
        width = max(8, 1 << int(sizes[order[0]]).bit_length())
        take = min(int(np.searchsorted(sizes[order], width)), max(1, most_nodes // (4 * (width + 1))))
        rows, order = order[:take], order[take:]
        block = np.zeros((len(rows), width), dtype=np.int64)
        n = sizes[rows]
        to = np.repeat(np.arange(len(rows)) * width - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        source = np.repeat(offsets[rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        block.ravel()[to] = flat[source]
        yield rows, block, n


def _with_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with their cost matrix."""
    for batch in batches:
        out = np.zeros((batch.num_rows, 16), dtype=np.int64)
        for rows, codes, sizes in _padded(batch.column("codes")):
            out[rows] = segment_costs(codes, sizes).reshape(len(rows), 16)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * 16, pa.int32()), pa.array(out.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "costs"])


def _with_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a conversation, last first, with the costs from their end and the illegal pairs up to there."""
    known, conv, ends, after = False, None, ACCEPTED, OTHER
    for batch in batches:
        n = batch.num_rows
        costs = batch.column("costs").flatten().to_numpy(zero_copy_only=False).reshape(n, 4, 4)
        offsets = np.asarray(batch.column("codes").offsets)
        codes = batch.column("codes").flatten().to_numpy(zero_copy_only=False) & 3
        convs = batch.column("conv").to_pylist()
        out, last, illegal, cost = np.empty((n, 4), dtype=np.int64), np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        legal = np.zeros((4, 4), dtype=bool)
        legal[[SYSTEM, USER, ASSISTANT], [USER, ASSISTANT, USER]] = True
        base = offsets[0]
        for i in range(n):
            if not known or convs[i] != conv:
                known, conv, ends, last[i] = True, convs[i], ACCEPTED, True
            mine = codes[offsets[i] - base : offsets[i + 1] - base]
            illegal[i] = int((~legal[mine[:-1], mine[1:]]).sum()) + (not last[i] and not legal[mine[-1], after])
            out[i] = ends
            ends = np.minimum(FAR, (costs[i] + ends[None, :]).min(axis=1))
            cost[i], after = ends[0], mine[0]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 4, pa.int32()), pa.array(out.ravel()))
        kept = [batch.column(c) for c in ("conv", "seg", "codes", "blank", "duplicate", "truncated")]
        yield pa.RecordBatch.from_arrays(
            [*kept, lists, pa.array(last), pa.array(illegal), pa.array(cost)],
            names=["conv", "seg", "codes", "blank", "duplicate", "truncated", "ends", "last", "illegal", "cost"],
        )


def _with_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with the least path and the end state from each of the four states."""
    for batch in batches:
        n = batch.num_rows
        ends = batch.column("ends").flatten().to_numpy(zero_copy_only=False).reshape(n, 4)
        last = batch.column("last").to_numpy(zero_copy_only=False)
        steps: list[list[bytes]] = [[]] * n
        final = np.zeros((n, 4), dtype=np.int8)
        for rows, codes, sizes in _padded(batch.column("codes"), NODES // 4):
            found, left = least_paths(codes, sizes, ends[rows], last[rows])
            final[rows] = left
            found = found.astype(np.uint8)
            for k, row in enumerate(rows.tolist()):
                used = int(sizes[k]) + bool(last[row])
                steps[row] = [found[k, q, :used].tobytes() for q in range(4)]
        flat = pa.array([s for four in steps for s in four], pa.binary())
        bounds = pa.array(np.arange(n + 1) * 4, pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, flat), pa.ListArray.from_arrays(bounds, pa.array(final.ravel()))]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("seg"), *lists], names=["conv", "seg", "steps", "final"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The steps of each segment, first to last, from the state in which the segment before ends."""
    known, conv, state = False, None, 0
    for batch in batches:
        final = batch.column("final").flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
        steps = batch.column("steps").flatten().to_pylist()
        chosen = []
        for i, name in enumerate(batch.column("conv").to_pylist()):
            if not known or name != conv:
                known, conv, state = True, name, 0
            chosen.append(list(steps[4 * i + state]))
            state = int(final[i, state])
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("seg"), pa.array(chosen, pa.list_(pa.int32()))], names=["conv", "seg", "steps"]
        )


def _messages(step: Column) -> Column:
    """The messages that a step leaves, inserted ones first."""
    inserts, state, edit = F.shiftright(step, 2).bitwiseAND(3), F.shiftright(step, 4), step.bitwiseAND(3)
    second = state == 2

    def message(role: Column, text: Column) -> Column:
        return F.struct(role.alias("role"), text.alias("text"))

    def turn_role(assistant: Column) -> Column:
        return F.when(assistant, F.lit("assistant")).otherwise(F.lit("user"))

    one, two = message(turn_role(second), F.lit("")), message(turn_role(~second), F.lit(""))
    none = F.array().cast("array<struct<role:string,text:string>>")
    added = F.when(inserts == 1, F.array(one)).when(inserts == 2, F.array(one, two)).otherwise(none)
    # An odd number of insertions changes whose turn it is.
    whose = second != (inserts == 1)
    own = F.when(edit == 2, F.array(message(F.col("role"), F.col("text")))).when(
        edit == 3, F.array(message(turn_role(whose), F.col("text")))
    )
    return F.concat(added, F.coalesce(own, none))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """Faults, least edits and repaired messages of all conversations; see the module."""
    kind = rows.schema[conv].dataType.simpleString()
    plain = rows.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    numbered = number_rows(plain, ["conv"], order, "position")
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    numbered = written(
        numbered.withColumns(
            {
                "digest": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256),
                "is_blank": bare == "",
                "is_cut": ~F.substring(bare, -1, 1).isin(".", "!", "?"),
            }
        ),
        "messages",
    )
    # Joined by position too, so that no frequent message meets in one task.
    firsts = numbered.groupBy("conv", "digest").agg(F.min("position").alias("position")).select(
        F.col("conv").alias("_conv"), F.col("digest").alias("_digest"), F.col("position").alias("_position")
    )
    light = numbered.select("conv", "position", "digest", "is_blank", "is_cut", F.substring("role", 1, 1).alias("initial"))
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")) & (F.col("position") == F.col("_position"))
    light = light.join(firsts, same, "left")
    fault = (
        F.when(F.col("is_blank"), F.lit("blank"))
        .when(F.col("_position").isNull(), F.lit("duplicate"))
        .when(F.col("is_cut"), F.lit("truncated"))
    )
    light = light.withColumn("fault", fault)
    role_code = F.when(F.col("initial") == "s", SYSTEM).when(F.col("initial") == "u", USER).when(F.col("initial") == "a", ASSISTANT).otherwise(OTHER)
    code = role_code + F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", CUT).otherwise(0)
    light = written(light.select("conv", "position", "fault", code.cast("int").alias("code")), "message-codes")

    segment = F.floor((F.col("position") - 1) / SEGMENT).cast("long").alias("seg")
    segments = light.groupBy("conv", segment).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "code"))), lambda p: p["code"]).alias("codes"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    counts = "blank long, duplicate long, truncated long"
    costs = segments.mapInArrow(_with_costs, f"conv {kind}, seg long, codes array<int>, {counts}, costs array<long>")
    backward = costs.repartition("conv").sortWithinPartitions("conv", F.col("seg").desc())
    ended = written(
        backward.mapInArrow(_with_ends, f"conv {kind}, seg long, codes array<int>, {counts}, ends array<long>, last boolean, illegal long, cost long"),
        "segment-costs",
    )
    paths = ended.repartition("conv", "seg").mapInArrow(_with_paths, f"conv {kind}, seg long, steps array<binary>, final array<tinyint>")
    forward = paths.repartition("conv").sortWithinPartitions("conv", "seg")
    chosen = forward.mapInArrow(_chained, f"conv {kind}, seg long, steps array<int>")
    edits = chosen.select(F.col("conv").alias("_conv"), "seg", F.posexplode("steps").alias("_at", "step")).select(
        "_conv", (F.col("seg") * SEGMENT + F.col("_at") + 1).cast("int").alias("_position"), "step"
    )
    faults = light.select(F.col("conv").alias("_c"), F.col("position").alias("_p"), "fault")
    texts = numbered.select("conv", "position", "turn", "role", "text")
    on = F.col("_conv").eqNullSafe(F.col("conv")) & (F.col("_position") == F.col("position"))
    also = F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_position") == F.col("_p"))
    edit = F.concat(
        F.repeat(F.lit("I"), F.shiftright("step", 2).bitwiseAND(3)),
        F.element_at(F.array(*map(F.lit, ("", "D", "K", "R"))), F.col("step").bitwiseAND(3) + 1),
    )
    joined = edits.join(faults, also, "left").join(texts, on, "left")
    result = joined.select(
        F.col("_conv").alias("conv"),
        F.col("_position").alias("position"),
        "turn",
        "fault",
        edit.alias("edit"),
        _messages(F.col("step")).alias("messages"),
    ).filter(F.col("edit") != "")
    sums = ended.groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
        F.sum(F.when(F.col("seg") == 0, F.col("cost"))).alias("cost"),
    )
    spans = numbered.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long").alias("gaps"))
    spans = spans.select(F.col("conv").alias("_conv"), F.coalesce("gaps", F.lit(0)).alias("gaps"))
    summary = sums.join(spans, F.col("conv").eqNullSafe(F.col("_conv")))
    return Repair(result, summary.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest of each conversation out of its edits in order; only the digest's state and the audit are kept."""
    import hashlib

    known, conv, audit, digest, begun = False, None, [], None, False
    done: tuple[list, list[str], list[str]] = ([], [], [])

    def close() -> None:
        done[0].append(conv)
        done[1].append("".join(audit))
        done[2].append(digest.hexdigest())

    kind = None
    for batch in batches:
        kind = batch.schema.field("conv").type
        rows = zip(batch.column("conv").to_pylist(), batch.column("edit").to_pylist(), batch.column("lines").to_pylist())
        for name, edit, lines in rows:
            if not known or name != conv:
                if known:
                    close()
                known, conv, audit, digest, begun = True, name, [], hashlib.sha256(), False
            audit.append(edit)
            if lines is not None:
                digest.update(("\n" + lines if begun else lines).encode())
                begun = True
        if done[0]:
            yield pa.RecordBatch.from_arrays([pa.array(done[0], kind), pa.array(done[1]), pa.array(done[2])], names=["conv", "audit", "repaired_sha256"])
            done = ([], [], [])
    if known:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done[0], kind), pa.array(done[1]), pa.array(done[2])], names=["conv", "audit", "repaired_sha256"])


def digests(edits: DataFrame) -> DataFrame:
    """The audit and the SHA-256 of the repaired ``role:text`` lines of every conversation.

    A digest is sequential by nature: the edits of a conversation pass through one task, row by row.
    """
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    lines = F.when(F.size("messages") > 0, F.array_join(line, "\n"))
    ordered = edits.select("conv", "position", "edit", lines.alias("lines")).repartition("conv").sortWithinPartitions("conv", "position")
    kind = edits.schema["conv"].dataType.simpleString()
    return ordered.mapInArrow(_hashed, f"conv {kind}, audit string, repaired_sha256 string")
