"""Events and plan tables: literal scenarios."""

import datetime as dt
import json

import pytest
from pyspark.sql import Row, functions as F

from worklens import vocab
from worklens.operators import events, extraction, ingest, metrics, quality
from worklens.plans import design, lifecycle
from worklens.plans.policy import Policy, identity
from worklens.scale import number_rows
from worklens.sources import items as item_source

NOW_TEXT = "2026-07-02 12:00:00"
def now():
    return F.lit(NOW_TEXT).cast("timestamp")

T = dt.datetime(2026, 7, 2, 12, 0, 0)
POLICY = Policy("b1", ("topics",), ("trash",), "done")


@pytest.mark.parametrize(
    ("event_type", "column", "expected"),
    [
        ("create_item", "", "webhook_create"),
        ("move_pulse_into_group", "", "webhook_move"),
        ("change_column_value", vocab.EMAIL_COLUMN, "webhook_email"),
        ("change_column_value", "name", "webhook_name"),
        ("create_item", vocab.AI_DATA_COLUMN, None),
        ("create_item", vocab.MATCH_REPORT_COLUMN, None),
        (None, None, None),
    ],
)
def test_trigger_types(spark, event_type, column, expected):
    df = spark.createDataFrame([(event_type, column)], "t string, c string")
    assert df.select(events.trigger_type("t", "c")).first()[0] == expected


def test_payload_hash_uses_python_number_text(spark):
    payload = '{"b": 1.0, "a": "é", "c": [1, {"z": null}]}'
    df = spark.createDataFrame([(payload,), ("not json",)], "payload string")
    import hashlib

    canonical = json.dumps(json.loads(payload), sort_keys=True, separators=(",", ":"))
    rows = [r.idempotency_key for r in events.normalize(df).collect()]
    assert rows == ["payload:" + hashlib.sha256(canonical.encode()).hexdigest(), None]


def test_events_without_dispatches_are_processing(spark):
    all_events = spark.createDataFrame([(1,), (2,)], "event_id int")
    dispatches = spark.createDataFrame([(1, "auto_sync", "failed"), (1, "design_processing", "succeeded")], "event_id int, consumer string, status string")
    rows = {r.event_id: (r.event_status, r.error) for r in events.roll_up_events(all_events, dispatches).collect()}
    assert rows == {1: ("partial_failed", "failed consumers: auto_sync"), 2: ("processing", None)}


def test_debounce_joins_gaps_up_to_ninety_seconds(spark):
    at = [0, 90, 91, 182, 400]
    rows = [("i", n, T + dt.timedelta(seconds=s), f"t{n}", "rev-2" if n == 1 else None) for n, s in enumerate(at)]
    df = spark.createDataFrame(rows, "item_id string, event_id int, received_at timestamp, trigger_type string, desired_source_revision string")
    jobs = events.debounce(df, ["item_id"]).orderBy("first_at").collect()
    assert [(j.n_events, j.trigger_type, j.desired_source_revision) for j in jobs] == [(3, "t2", "rev-2"), (1, "t3", None), (1, "t4", None)]
    assert jobs[0].scheduled_for - jobs[0].last_at == dt.timedelta(seconds=90)


def test_reconciliation_scenario(spark):
    schema = "external_task_key string, board_id string, item_id string, auto_sync_state string, sync_status string, sync_started_at timestamp, sync_requested_at timestamp, last_indexed_source_revision string, latest_snapshot_version string"

    def task(item, status="completed", revision=None, started=None):
        return (f"acct:b1:{item}", "b1", item, "active", status, started, None, revision, revision)

    tasks = spark.createDataFrame(
        [
            task("fresh", revision="rev-fresh"),
            task("stale", revision="old-rev"),
            task("failed", "failed", "rev-failed"),
            task("stuck", "syncing", "rev-stuck", T - dt.timedelta(hours=2)),
        ],
        schema,
    )
    names = ["fresh", "stale", "failed", "stuck", "missing"]
    items = spark.createDataFrame(
        [(f"acct:b1:{n}", "b1", n, "topics", f"rev-{n}") for n in names],
        "external_task_key string, board_id string, item_id string, group_id string, source_revision string",
    )
    jobs = spark.createDataFrame([], "board_id string, item_id string, status string")
    plan = lifecycle.reconciliation_plan(items, tasks, jobs, POLICY, now=now())
    rows = {r.item_id: (r.action, r.job_revision) for r in plan.collect()}
    assert rows == {
        "fresh": ("fresh", None),
        "stale": ("would_queue_stale", "rev-stale"),
        "failed": ("would_queue_failed", None),
        "stuck": ("would_queue_stuck", None),
        "missing": ("would_queue_missing", "rev-missing"),
    }
    summary = lifecycle.run_summary(plan, F.col("queue")).first()
    assert (summary.scanned, summary.queued, summary.skipped, summary.errors) == (5, 4, 1, 0)


def test_purge_scenario(spark):
    schema = "external_task_key string, board_id string, auto_sync_state string, sync_status string, purge_after timestamp, retention_hold boolean, latest_snapshot_version string, last_indexed_source_revision string, sync_error string, raw_purged_at timestamp, last_sync_result string, updated_at timestamp"

    def task(key, hold):
        return (key, "b1", "completed_retained", "completed", T - dt.timedelta(days=1), hold, "rev-1", "rev-1", None, None, "done", T)

    tasks = spark.createDataFrame([task("due", None), task("held", True)], schema)
    files = spark.createDataFrame(
        [("f1", "due", "bucket", "object/path.pdf", "stored", None, T), ("f2", "due", "bucket", "x", "unsupported", None, T), ("f3", "held", "bucket", "y", "stored", None, T)],
        "id string, external_task_key string, bucket string, object_path string, storage_status string, deleted_at timestamp, created_at timestamp",
    )
    chunks = spark.createDataFrame([("c1", "f1"), ("c3", "f3")], "id string, file_id string")
    due = lifecycle.due_for_purge(tasks, "b1", now())
    manifest = lifecycle.delete_manifest(due, files)
    assert [(r.bucket, r.object_path) for r in manifest.collect()] == [("bucket", "object/path.pdf")]
    for error, action, kept in ((None, "expired", ["c3"]), ("denied", "storage_failed", ["c1", "c3"])):
        results = spark.createDataFrame([("f1", error)], "id string, error string")
        outcome = lifecycle.purge_outcome(due, manifest, results)
        assert [r.action for r in outcome.collect()] == [action]
        assert sorted(r.id for r in lifecycle.rows_kept(chunks, outcome, files).collect()) == kept
        row = {r.external_task_key: r for r in lifecycle.tombstones(tasks, outcome, now()).collect()}
        assert row["held"].auto_sync_state == "completed_retained"
        assert row["due"].last_indexed_source_revision == "rev-1"
        if error is None:
            assert (row["due"].auto_sync_state, row["due"].latest_snapshot_version, row["due"].last_sync_result) == ("expired", None, "skipped")
        else:
            assert row["due"].sync_error == "Purge failed to delete 1 Storage object(s)"
            assert row["due"].auto_sync_state == "storage_deleting"


def test_metrics_scenario(spark):
    pair = "struct<input_revision:string,pipeline_version:string>"
    i = Row("input_revision", "pipeline_version")("rev", "p")
    items = spark.createDataFrame(
        [("b", "1", "analyzed", i, i, None, None), ("b", "2", "waiting_for_email", None, None, None, None)],
        f"board_id string, item_id string, state string, desired {pair}, analyzed {pair}, published {pair}, supersession_requested_at timestamp",
    )
    hours = lambda h: T - dt.timedelta(hours=h)
    jobs = spark.createDataFrame(
        [
            ("retry_wait", "waiting_for_email", None, 0, 4, None, None, None, None, hours(2), None),
            ("completed", "rendering", "analysis", 2, 0, None, None, hours(1), hours(0.5), hours(1), None),
            ("completed", "matching", "publication", 1, 0, None, None, hours(1), hours(0.5), hours(1), None),
        ],
        "status string, stage string, execution_kind string, attempt_count int, readiness_check_count int, locked_at timestamp, heartbeat_at timestamp, started_at timestamp, completed_at timestamp, created_at timestamp, superseded_by_revision string",
    )
    artifacts = spark.createDataFrame([], "status string, last_error string")
    dispatches = spark.createDataFrame([("design_processing", "succeeded", "queued"), ("auto_sync", "failed", None)], "consumer string, status string, outcome string")
    m = metrics.operations_metrics(items, jobs, artifacts, dispatches, now=now()).first()
    assert m.queue_depth == {"retry_wait": 1} and m.items_by_state == {"analyzed": 1, "waiting_for_email": 1}
    assert (m.readiness_waiting_jobs, m.readiness_checks_total, m.readiness_oldest_age_seconds) == (1, 4, 7200.0)
    assert (m.attempts_total, m.attempts_p95, m.analyzed_not_published) == (3, 2.0, 1)
    assert m.dispatch_outcome == {"queued": 1} and m.dispatch_status == {"succeeded": 1}
    assert (m.cleanup_delete_pending, m.cleanup_delete_pending_with_errors, m.cleanup_deleted) == (0, 0, 0)
    assert (m.publication_latency_count, m.publication_latency_p50) == (1, 1800.0)
    assert (m.leases_running, m.leases_oldest_heartbeat_age_seconds) == (0, None)


def test_half_filled_identities_break_a_rule(spark):
    items = spark.createDataFrame(
        [("b", "1", "scheduled", "r", None, None, None, None, None), ("b", "1", "odd", None, None, None, None, None, None)],
        "board_id string, item_id string, state string, desired_input_revision string, desired_pipeline_version string, analyzed_input_revision string, analyzed_pipeline_version string, published_input_revision string, published_pipeline_version string",
    )
    found = {(r.rule, r.key, r.n) for r in quality.integrity_violations(items=items).collect()}
    assert found == {("item_desired_identity", "b:1", 1), ("item_state", "b:1", 1), ("item_unique", "b:1", 2)}
    assert spark.range(1).select(identity(F.lit("r"), F.lit(None).cast("string"))).first()[0] is None


def test_intake_contract(spark):
    from worklens import schemas

    def item(files, assets, name="Enquiry"):
        return {
            "id": "2657106977",
            "state": "active",
            "name": name,
            "board": {"id": "1"},
            "group": {"id": "g"},
            "assets": assets,
            "column_values": [{"id": vocab.EMAIL_COLUMN, "type": "file", "value": files if isinstance(files, str) else json.dumps({"files": files})}],
        }

    def asset(i, name, **more):
        return {"id": i, "name": name, "file_extension": name.rsplit(".", 1)[-1], "file_size": "10", "created_at": "2026-07-29T10:45:00+01:00", "url": "u", **more}

    docs = [
        item(
            [{"assetId": "00012", "name": "Later.eml"}, {"assetId": "3", "name": "Earlier.msg"}, {"assetId": "9", "name": "Ignored.pdf"}],
            [asset("12", "Later.eml", file_size="20"), asset("9", "Ignored.pdf"), asset("3", "Earlier.msg")],
        ),
        item([{"assetId": "5", "name": "gone.eml"}, {"assetId": "6", "name": "gone.pdf"}], []),
        item([{"assetId": "1", "name": "a.eml"}, {"assetId": "01", "name": "a.eml"}], [asset("1", "a.eml", url=None)]),
        item("{bad", [asset("1", "a.eml"), asset("01", "b.eml")], name="  "),
        item("", []),
    ]
    df = spark.read.schema(schemas.ITEM).json(spark.sparkContext.parallelize([json.dumps(d) for d in docs], 1))
    rows = quality.intake_contract(df).collect()
    assert [a.asset_id for a in rows[0].email_assets] == ["12", "3"] and rows[0].errors == []
    records = [{"assetId": "3", "createdAt": "2026-07-29T09:45:00Z", "filename": "Earlier.msg", "size": 10}, {"assetId": "12", "createdAt": "2026-07-29T09:45:00Z", "filename": "Later.eml", "size": 20}]
    import hashlib

    assert rows[0].input_revision == hashlib.sha256(json.dumps(records, separators=(",", ":")).encode()).hexdigest()
    assert rows[1].errors == ["asset_metadata_missing"]
    assert rows[2].errors == ["member_id_duplicate", "url_missing", "url_missing"]
    assert rows[3].errors == ["email_value_malformed", "asset_id_duplicate"] and rows[3].missing_name
    assert rows[4].errors == [] and rows[4].missing_email and rows[4].input_revision is None
    valid, rejects = quality.split_valid(quality.intake_contract(df))
    assert (valid.count(), rejects.count()) == (2, 3)


def test_item_documents(spark, tmp_path):
    from worklens import schemas  # noqa: F401

    doc = {
        "id": "7",
        "updated_at": "2026-01-01",
        "board": {"id": "b1"},
        "group": {"id": "topics"},
        "assets": [{"id": "10", "name": "a.eml"}, {"id": "9", "name": "b.pdf"}, {"id": "10", "name": "again.eml"}],
        "updates": [{"id": "u", "assets": [{"id": "9", "name": "b2"}, {"id": "11", "name": "c"}]}],
        "column_values": [
            {"id": "c", "type": "file", "column": {"title": "AI Data"}, "value": '{"files":[{"assetId":"10"}]}'},
            {"id": "d", "type": "file", "column": {"title": "Email"}, "value": '{"files":[{"assetId":"10"}]}'},
        ],
    }
    path = tmp_path / "items"
    path.mkdir()
    (path / "one.json").write_text(json.dumps(doc))
    items = item_source.read_items(spark, str(path), account_id="acct")
    row = item_source.resolve_identity(items).first()
    assert row.external_task_key == "acct:b1:7" and row.errors == []
    import hashlib

    assert row.source_revision == hashlib.sha256(b"2026-01-01:10,11,9").hexdigest()
    jobs = item_source.asset_jobs(items.withColumn("item_id", F.col("id"))).orderBy("pos").collect()
    assert [(j.asset_id, j.kind, j.asset.name) for j in jobs] == [("10", "email", "a.eml"), ("9", "attachment", "b.pdf"), ("11", "update_attachment", "c")]


def test_parameters_golden(spark):
    fields = {"Email Subject": "FW: Drawings", "Post Code": "WA4 6NL", "Date Received": "01 Jan 2000", "Hour Received": "00:00", "Tapered Insulation": "TR27", "Revision": "Not found", "Scale": None}
    text = "EMAIL CONTENT:\nFrom: D\nTo: S\nSubject: FW\nDate: Fri, 30 Jan 2026 15:45:07 +0000\n\nbody"
    df = spark.createDataFrame([("i", text, fields)], "item_id string, all_text string, fields map<string,string>")
    rows = {r.parameter: (r.value, r.source) for r in extraction.canonical_parameters(df).collect()}
    assert rows["Post Code"] == ("WA", "Email Content") and rows["Tapered Insulation"][0] == "TissueFaced PIR"
    assert (rows["Date Received"][0], rows["Hour Received"][0]) == ("30 Jan 2026", "15:45")
    assert rows["Revision"][0] == "Not found" and rows["Scale"][0] == "Not provided"
    assert rows["Reason for Change"] == ("Reviewer decision required", "Business Rule")
    assert set(rows) == set(vocab.CANONICAL_PARAMETERS)
    ordered = extraction.report_rows(extraction.canonical_parameters(df)).orderBy("seq").collect()
    assert [r.parameter for r in ordered] == list(vocab.CANONICAL_PARAMETERS)


def test_number_rows_of_a_hot_key(spark):
    rows = [("hot", i) for i in range(3000)] + [("cold", i) for i in range(10)] + [(None, 5)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(7)
    got = number_rows(df, ["k"], [F.col("v").desc()]).collect()
    assert len(got) == len(rows)
    for r in got:
        size = {"hot": 3000, "cold": 10, None: 6}[r.k]
        assert r.row_index == (1 if r.k is None else size - r.v)


def test_snapshot_deduplication_drops_clashing_files(spark):
    snapshots = spark.createDataFrame([("s1", "t", "v", T), ("s2", "t", "v", T + dt.timedelta(1)), ("s3", "t", "w", T)], "id string, external_task_key string, snapshot_version string, created_at timestamp")
    files = spark.createDataFrame([("f1", "t", "s1", "a"), ("f2", "t", "s2", "a"), ("f3", "t", "s1", "b"), ("f4", "t", "s3", "a")], "id string, external_task_key string, snapshot_id string, asset_id string")
    chunks = spark.createDataFrame([(f"c{i}", f"f{i}") for i in range(1, 5)], "id string, file_id string")
    kept, moved, left = lifecycle.deduplicate_snapshots(snapshots, files, chunks)
    assert sorted(r.id for r in kept.collect()) == ["s2", "s3"]
    assert sorted((r.id, r.snapshot_id) for r in moved.collect()) == [("f2", "s2"), ("f3", "s2"), ("f4", "s3")]
    assert sorted(r.file_id for r in left.collect()) == ["f2", "f3", "f4"]


def test_metadata_conflicts(spark):
    schema = "id string, board_id string, item_id string, column_id string, artifact_kind string, input_revision string, pipeline_version string, deterministic_filename string, content_sha256 string, size_bytes long, status string"
    stored = spark.createDataFrame([("a", "b", "i", "c", "ai_data", "r", "p", "f", "h", 1, "rendered"), ("z", "b", "j", "c", "ai_data", "r", "p", "f", "h", 1, "published")], schema)
    new = stored.withColumn("content_sha256", F.when(F.col("id") == "a", "other").otherwise(F.col("content_sha256")))
    assert [r.id for r in quality.metadata_conflicts(stored, new).collect()] == ["a"]


def test_landing_limit_stops_the_scan(spark):
    days = [0, 5, 1, 6, 2, 7]
    group = spark.createDataFrame([(str(n), T + dt.timedelta(days=d), n) for n, d in enumerate(days)], "item_id string, created_at timestamp, source_pos int")
    snapshots = group.select("item_id", F.lit("b1").alias("board_id"), F.lit("g0").alias("group_id"), F.lit("active").alias("item_state"), F.lit(False).alias("missing_name"), F.lit(False).alias("missing_email"), F.lit("r").alias("input_revision"))
    pair = "struct<input_revision:string,pipeline_version:string>"
    items = spark.createDataFrame([], f"board_id string, item_id string, state string, desired {pair}, analyzed {pair}, published {pair}")
    jobs = spark.createDataFrame([], f"id string, board_id string, item_id string, status string, execution_kind string, execution {pair}, created_at timestamp")
    settings = dict(mode="shadow", pipeline_version="p", board_id="b1", group_id="g0")
    activation = F.lit(T + dt.timedelta(days=4)).cast("timestamp")
    rows = design.landing_plan(group, snapshots, items, jobs, activation=activation, limit=2, **settings).collect()
    assert sorted((r.item_id, r.action) for r in rows) == [("0", "skipped"), ("1", "would_queued"), ("2", "skipped"), ("3", "would_queued")]
    rows = design.landing_plan(group, snapshots, items, jobs, activation=activation, limit=9, **settings).collect()
    assert len(rows) == 6


def test_mail_attachment_documents(spark):
    assets = spark.createDataFrame([("f", "i", "m.eml", "m.eml", "email", 10), ("g", "i", "p.gif", "p.gif", "image_placeholder", 5), ("h", "i", "t.csv", "t.csv", "csv", 5)], "file_id string, item_id string, path string, filename string, route string, actual_size long")
    csv = spark.createDataFrame([("t.csv", 1, "Parameter: a | Value: b | Source: c")], "path string, row_index int, text string")
    parts = [("m.eml", "header", None, "From: x", None, 0), ("m.eml", "body", None, " ", None, 1)]
    parts += [("m.eml", "attachment", f"a{i:02d}.pdf", None, 10, 2 + i) for i in range(10)]
    mail = spark.createDataFrame(parts, "path string, part_kind string, filename string, text string, size_bytes long, part_index int")
    extracted = spark.createDataFrame([("m.eml", "a00.pdf", "hello")], "path string, attachment string, text string")
    items = spark.createDataFrame([("i", [])], "item_id string, column_values array<struct<column:struct<title:string>,value:string,text:string,display_value:string>>")
    rows = ingest.ingest_documents(assets, csv, mail, extracted, items).collect()
    by_section = {r.section: r.text for r in rows}
    assert by_section["row:1"].startswith("Parameter: a") and by_section["email:header"] == "From: x" and "email:body" not in by_section
    assert by_section["email:attachment:a00.pdf"] == "PDF ATTACHMENT (a00.pdf):\nhello"
    assert sum(s.startswith("email:attachment") for s in by_section) == 10
    limited = ingest.ingest_documents(assets, csv, mail, extracted, items, attachments_per_kind=8, max_pdf_bytes=5).collect()
    assert sum("attachment limit" in r.text for r in limited) == 2 and sum("Too large" in r.text for r in limited) == 8
    large = ingest.ingest_documents(assets, csv, mail, extracted, items, max_mail_bytes=5).collect()
    assert [r.text for r in large if r.kind == "email"] == ["Email too large for extraction (10 bytes)."]
    assert by_section["image:description"] == "Unsupported image format: gif"


def test_of_two_duplicates_with_one_asset_only_the_latest_moves(spark):
    snapshots = [(str(n), "k", "v", dt.datetime(2024, 1, n)) for n in (1, 2, 3)]
    files = [("f1", "1", "k", "a"), ("f2", "2", "k", "a"), ("f3", "3", "k", "b"), ("f4", "1", "k", "b"), ("f5", "1", "k", None), ("f6", "2", "k", None)]
    stays, moved, left = lifecycle.deduplicate_snapshots(
        spark.createDataFrame(snapshots, "id string, external_task_key string, snapshot_version string, created_at timestamp"),
        spark.createDataFrame(files, "id string, snapshot_id string, external_task_key string, asset_id string"),
        spark.createDataFrame([(f[0],) for f in files], "file_id string"),
    )
    assert [r.id for r in stays.collect()] == ["3"]
    assert {(r.id, r.snapshot_id, r.asset_id) for r in moved.collect()} == {("f2", "3", "a"), ("f3", "3", "b"), ("f5", "3", None), ("f6", "3", None)}
    assert {r.file_id for r in left.collect()} == {"f2", "f3", "f5", "f6"}
