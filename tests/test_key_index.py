"""The index of delivered keys: exact, and read only where a batch's keys can be."""

import random

import pytest
from pyspark.sql import functions as F

from worklens.streaming import events as stream_ops
from worklens.streaming.key_index import KeyIndex

SCHEMA = "idempotency_key string, event_id long, received_at timestamp"


def arrive(spark, folder, batches):
    """One file for each micro-batch, in order."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def rows_of(keys, first_id):
    import datetime as dt

    return [(k, first_id + i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i)) for i, k in enumerate(keys)]


def test_a_batch_reads_what_its_keys_need_however_long_the_history(spark, tmp_path):
    """Fourteen micro-batches: each key once, and files opened do not grow while the history does."""
    rng = random.Random(4)
    batches, seen = [], []
    for number in range(14):
        new = [f"k{number}-{i}" for i in range(150)]
        again = rng.sample(seen, 3) if seen else []
        seen += new
        batches.append(rows_of([*new, *again, new[0]], 1000 * number))
    out = str(tmp_path / "out")
    stream = arrive(spark, tmp_path / "in", batches)
    stream_ops.run_first_deliveries(stream, str(tmp_path / "cp"), out, keys_per_file=40, fan=3).awaitTermination()
    stored = [(r.idempotency_key, r.event_id) for r in spark.read.parquet(out).select("idempotency_key", "event_id").collect()]
    want = {}
    for batch in batches:
        for key, event_id, _ in batch:
            want.setdefault(key, event_id)
    assert sorted(stored) == sorted(want.items())

    index = stream_ops.key_index(spark, out)
    read = [tuple(r) for r in index.lookups().orderBy("batch").select("runs", "files_opened", "keys_read").collect()]
    assert len(read) == 14
    # Three repeated keys are in three files; a filter is wrong for a few of 150 new keys and each run.
    assert all(opened >= 3 for _, opened, _ in read[1:])
    early, late = read[3:6], read[-3:]
    assert max(k for _, _, k in late) <= 2 * max(k for _, _, k in early)
    total = 14 * 150
    assert all(keys < total / 3 for _, _, keys in read)
    runs = index.runs(13)
    assert sum(r.keys for r in runs) == total and len(runs) <= 6 and max(r.level for r in runs) >= 2
    # Files stay alike: a larger run has more of them.
    assert {-(-r.keys // 2**r.bits) for r in runs} <= set(range(18, 41))


def test_a_repeated_batch_replaces_what_an_interrupted_one_left(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "keys"), "k", keys_per_file=10, fan=2)
    frames = [spark.createDataFrame([(f"b{n}-{i}",) for i in range(25)], "k string") for n in range(4)]
    runs = []
    for n, frame in enumerate(frames):
        index.add(frame.limit(7), n, runs)  # an attempt that ends before it is published
        runs = index.add(frame, n, index.runs(n - 1))
        index.publish(n, runs, index.lookup(frame, []))
    assert sum(r.keys for r in index.runs(3)) == 100
    probe = spark.createDataFrame([("b0-3",), ("b3-24",), ("new",)], "k string")
    found = index.lookup(probe, index.runs(3))
    assert sorted(r.k for r in probe.join(found.known, "k", "left_semi").collect()) == ["b0-3", "b3-24"]
    assert index.lookup(probe.limit(0), index.runs(3)).known is None
    assert index.lookup(probe, index.runs(-1)).known is None


@pytest.mark.parametrize("size", [1, 1000])
def test_filters_know_every_key(spark, tmp_path, size):
    index = KeyIndex(spark, str(tmp_path / "keys"), "k", keys_per_file=100)
    frame = spark.range(size).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("k"))
    runs = index.add(frame, 0, [])
    found = index.lookup(frame, runs)
    assert frame.join(found.known, "k", "left_semi").count() == size
    strangers = spark.range(300).select(F.concat(F.lit("y"), F.col("id").cast("string")).alias("k"))
    probes = index.lookup(strangers.limit(1), runs)
    assert probes.filters_read == 1 and probes.files_opened <= 1
