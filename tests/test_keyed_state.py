"""Item states in the state store: equal to whole histories, and bounded in what a batch touches."""

import random

import pytest

from worklens.streaming import keyed_state, state

SCHEMA = "board_id string, item_id string, seq long, kind string, readiness string, execution_kind string, input_revision string, pipeline_version string"


def observations(rng, item, n):
    rows = []
    for seq in range(n):
        kind = rng.choice(["snapshot", "snapshot", "started", "finished"])
        readiness = rng.choice(["ready", "ready", "waiting_for_email", "failed"]) if kind == "snapshot" else None
        execution = rng.choice(["analysis", "publication", None]) if kind == "started" else None
        revision = rng.choice(["r1", "r2", "", None]) if kind != "finished" else None
        rows.append(("b", item, seq, kind, readiness, execution, revision, rng.choice(["p", "p", "p", None])))
    return rows


def run(spark, folder, batches, **options):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    keyed_state.run_keyed_item_states(stream, f"{folder}/cp", f"{folder}/out", **options).awaitTermination()
    return keyed_state.current_states(spark, f"{folder}/out")


@pytest.mark.parametrize("allowed", [True, False])
def test_states_out_of_order_equal_whole_histories(spark, tmp_path, allowed):
    """Eleven micro-batches of shuffled observations, slices of four."""
    rng = random.Random(21)
    rows = [r for i in range(6) for r in observations(rng, f"i{i}", 40)] + observations(rng, "hot", 200)
    rng.shuffle(rows)
    batches = [rows[k::11] for k in range(11)]
    got = run(spark, str(tmp_path), batches, publication_allowed=allowed, slice_size=4)
    want = state.item_states(spark.createDataFrame(rows, SCHEMA), allowed).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_late_observation_touches_its_slice_only_until_nothing_changes(spark, tmp_path):
    """One item of 2,000 observations: a late one sets a bounded number of states, not the whole history."""
    rows = [("b", "i", 2 * n, "snapshot", "ready", None, f"r{n % 2}", "p") for n in range(2000)]
    late = [("b", "i", 1001, "snapshot", "ready", None, "other", "p")]
    started = [("b", "i", 3, "started", None, "analysis", "r0", "p")]
    run(spark, str(tmp_path), [rows[k : k + 250] for k in range(0, 2000, 250)] + [late, late, started], slice_size=20)
    sizes = {r["batch"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/out").groupBy("batch").count().collect()}
    assert all(sizes[n] <= 250 for n in range(8))
    # The late snapshot is overwritten by the next one; its repetition changes nothing more.
    assert sizes[8] <= 40 and sizes[9] <= 40
    # A run that never ends changes every later state, and all of them are corrected.
    assert sizes[10] == 2000 - 2 + 2
    want = state.item_states(spark.createDataFrame([*rows, *late, *started], SCHEMA))
    got = keyed_state.current_states(spark, f"{tmp_path}/out")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


class Messages:
    """State of one key that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def called(self, out=None):
        self.calls += 1
        return out

    def get(self):
        return self.called(self.held.get(()))

    def update(self, value):
        self.called(self.held.__setitem__((), value))

    def exists(self):
        return self.called(() in self.held)

    def getValue(self, key):
        return self.called(self.held.get(key))

    def containsKey(self, key):
        return self.called(key in self.held)

    def updateValue(self, key, value):
        self.called(self.held.__setitem__(key, value))

    def removeKey(self, key):
        self.called(self.held.__delitem__(key))

    def iterator(self):
        return iter(self.called(list(self.held.items())))


def test_slices_are_read_together_and_written_once():
    """A micro-batch that falls into every slice reads them by one message and writes each by one."""
    states = keyed_state.ItemStates(True, None, 4)
    states.starts, states.slices = Messages(), Messages()
    rng = random.Random(5)
    fields = {seq: list(row[3:]) for seq, row in enumerate(observations(rng, "i", 80))}
    states._merged({seq: f for seq, f in fields.items() if seq % 2})
    n = len(states.slices.held)
    states.starts.calls = states.slices.calls = 0
    states._merged({seq: f for seq, f in fields.items() if seq % 8 == 0})
    assert states.slices.calls <= 1 + n and states.starts.calls <= 2 and n >= 10


def test_only_changed_states_are_handed_on():
    """A snapshot that the next one overwrites corrects nothing behind that, not even in its own slice."""
    states = keyed_state.ItemStates(True, None, 256)
    states.starts, states.slices = Messages(), Messages()
    states._merged({2 * n: ["snapshot", "ready", None, f"r{n % 2}", "p"] for n in range(100)})
    assert [seq for seq, _ in states._merged({101: ["snapshot", "ready", None, "other", "p"]})] == [101]
