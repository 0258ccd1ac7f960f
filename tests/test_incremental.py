"""Work that is done once: cached stages, summaries counted while writing, framed histories."""

import random

import pytest
from pyspark.sql import functions as F

from worklens.operators import models, retrieval, stage_cache
from worklens.plans import lifecycle


def test_a_cached_stage_computes_each_content_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def make_client():
        def client(texts):
            calls.add(len(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return client

    def embed(rows):
        return models.embed_with(rows, make_client, "text", "vector")

    rows = [(i, t) for i, t in enumerate(["a", "bb", "a", "", None, "ccc", "bb", "a"])]
    docs = spark.createDataFrame(rows, "id int, text string")
    plain = sorted(map(str, embed(docs.filter("text is not null")).collect()))
    calls.value = 0
    path = str(tmp_path / "cache")
    first = stage_cache.cached(docs.filter("id < 3"), "text", "v1", path, embed)
    assert first.count() == 3 and calls.value == 2
    every = stage_cache.cached(docs, "text", "v1", path, embed).select("id", "text", "vector").collect()
    assert sorted(str(r) for r in every if r.text is not None) == plain
    assert [r.vector for r in every if r.text is None] == [None] and len(every) == 8
    assert calls.value == 4
    again = stage_cache.cached(docs, "text", "v1", path, embed)
    assert again.count() == 8 and calls.value == 4
    # Another version knows nothing of the first.
    stage_cache.cached(docs, "text", "v2", path, embed).count()
    assert calls.value == 8


def test_an_interrupted_stage_leaves_nothing(spark, tmp_path):
    docs = spark.createDataFrame([("a",), ("b",)], "text string")

    @F.udf("int")
    def fails(text):
        if text == "b":
            raise ValueError("model is down")
        return 1

    with pytest.raises(Exception):
        stage_cache.cached(docs, "text", "v", str(tmp_path), lambda rows: rows.withColumn("n", fails("text")))
    done = stage_cache.cached(docs, "text", "v", str(tmp_path), lambda rows: rows.withColumn("n", F.length("text")))
    assert sorted(r.n for r in done.collect()) == [1, 1]


def test_a_summary_is_counted_while_the_plan_is_written(spark, tmp_path):
    ran = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def action(i):
        ran.add(1)
        return ("error", "queue", "skip")[i % 3]

    plan = spark.range(90).select("id", action("id").alias("action"), F.when(F.col("id") < 30, "x").when(F.col("id") < 80, "y").alias("reason"))
    plan = plan.withColumn("queue", F.col("action") == "queue")
    path = str(tmp_path / "plan")
    got = lifecycle.write_with_summary(plan, path, F.col("queue"), "reason", ["x", "y", "z"])
    assert ran.value == 90
    want = lifecycle.run_summary(spark.read.parquet(path).filter("reason is not null"), F.col("queue"), "reason")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


@pytest.mark.parametrize("slice_rows", [3, 7, 4096])
def test_history_at_every_turn(spark, slice_rows):
    rng = random.Random(6)
    rows = [(c, k if k % 9 else None, rng.choice(["user", "assistant"]), rng.choice(["", " ", f"m{k}", "same"])) for c in (1, 2, None) for k in range(rng.randint(1, 40))]
    rng.shuffle(rows)
    got = retrieval.running_history(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), 3, slice_rows=slice_rows)
    found = {(r.conv_id, r.position): [tuple(m) for m in r.history] for r in got.collect()}
    want = {}
    for c in (1, 2, None):
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        for p in range(len(mine)):
            want[c, p + 1] = [(t, role, text.strip()) for _, t, role, text in mine[max(0, p - 2) : p + 1] if text.strip()]
    assert found == want


def test_a_micro_batch_keeps_the_version_it_noted(spark, tmp_path):
    """The item table changes between two micro-batches and again before one of them is repeated."""
    from worklens.streaming import events as stream_ops

    for part in ([(1, "a"), (2, "b")], [(3, "a")]):
        spark.createDataFrame(part, "event_id int, item_id string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id int, item_id string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    asked = []

    def newest():
        asked.append(f"v{len(asked)}")
        return asked[-1]

    def items_at(version):
        return spark.createDataFrame([("a", version, "active", "r")], "item_id string, group_id string, item_state string, source_revision string")

    out = str(tmp_path / "out")
    # An earlier attempt of the second batch had noted its version before it was lost.
    spark.createDataFrame([("noted",)], "version string").write.parquet(f"{out}/_versions/batch=1")
    stream_ops.run_current_items(stream, str(tmp_path / "cp"), out, newest, items_at).awaitTermination()
    rows = sorted((r.event_id, r.current_group_id, r.item_version) for r in spark.read.parquet(out).collect())
    assert rows == [(1, "v0", "v0"), (2, None, "v0"), (3, "noted", "noted")] and asked == ["v0"]
