"""Bursts joined in the state store: equal to whole histories, and only what changes is handed on."""

import datetime as dt
import random

from worklens.operators import events as ops
from worklens.streaming import keyed_bursts

SCHEMA = "item_id string, event_id long, received_at timestamp, trigger_type string, desired_source_revision string"
T0 = dt.datetime(2024, 5, 1)


def run(spark, folder, batches, gap, page):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    keyed_bursts.run_keyed_bursts(stream, ["item_id"], f"{folder}/cp", f"{folder}/out", gap, page).awaitTermination()
    return keyed_bursts.current_bursts(spark, ["item_id"], f"{folder}/out", gap)


def shown(df):
    return sorted(map(str, df.select("item_id", "first_at", "last_at", "n_events", "trigger_type", "desired_source_revision", "scheduled_for").collect()))


def test_bursts_out_of_order_equal_whole_histories(spark, tmp_path):
    rng = random.Random(31)
    rows = [
        (rng.choice(["a", "b", None]), n, T0 + dt.timedelta(seconds=rng.randint(0, 4000)), rng.choice(["x", "y", None]), rng.choice(["r1", "r2", None]))
        for n in range(700)
    ]
    rows += [("a", 900, rows[0][2], "z", None), ("edge", 901, T0, "x", "r"), ("edge", 902, T0 + dt.timedelta(seconds=10), "x", "r")]
    rng.shuffle(rows)
    got = run(spark, str(tmp_path), [rows[k::9] for k in range(9)], 10, 3)
    want = ops.debounce(spark.createDataFrame(rows, SCHEMA), ["item_id"], gap_seconds=10)
    assert shown(got) == shown(want) and got.count() > 100


def test_a_late_event_changes_only_the_bursts_it_joins(spark, tmp_path):
    rows = [("i", n, T0 + dt.timedelta(seconds=100 * n), "x", None) for n in range(500)]
    late = [("i", 900, T0 + dt.timedelta(seconds=25050), "late", "r")]
    got = run(spark, str(tmp_path), [rows[:250], rows[250:], late], 60, 16)
    changed = spark.read.parquet(f"{tmp_path}/out").filter("batch = 2").collect()
    assert sorted((r.n_events, r.gone) for r in changed) == [(1, True), (3, False)]
    assert got.count() == 499
    one = got.filter("n_events = 3").first()
    assert (one.trigger_type, one.desired_source_revision) == ("x", "r")


def test_pages_are_read_together_and_only_changed_ones_written():
    """A micro-batch that falls into every page reads them by one message; a page it leaves alone is not written."""
    from test_keyed_state import Messages

    def events(places):
        return [[at, at, 1, [at, at, "x"], None] for at in places]

    bursts = keyed_bursts.ItemBursts(10, 4, [])
    bursts.starts, bursts.pages = Messages(), Messages()
    bursts._merged(events(range(0, 4000, 100)))
    n = len(bursts.pages.held)
    bursts.starts.calls = bursts.pages.calls = 0
    bursts._merged(events(range(50, 4000, 100)))
    assert bursts.pages.calls <= 1 + 2 * n and n >= 8
    bursts.pages.calls = 0
    assert [b[:3] for b in bursts._merged(events([2005]))] == [[2000, 2005, 2, ]]
    assert bursts.pages.calls <= 4
