"""Files written by the tests, and streams that must equal their batch form."""

import datetime as dt
import hashlib
import json
from email.message import EmailMessage

from pyspark.sql import functions as F

from worklens.operators import events as ops, extraction
from worklens.sources import binary, csv_files, email_files, events as event_source, sinks
from worklens.streaming import events as stream_ops, state

T = dt.datetime(2026, 7, 2, 12, 0, 0)


def test_csv_dialects(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿ Parameter ;VALUE;source\n x ;1;s\n;;\ny;2;\n".encode())
    (tmp_path / "b.csv").write_text('Name,Size\n"a, b",1\n,\nc,2\n')
    files = binary.scan(spark, str(tmp_path), "*.csv")
    rows = csv_files.parameter_rows(files).orderBy("row_index").collect()
    assert [(r.row_index, r.parameter, r.value, r.source) for r in rows] == [(1, "x", "1", "s"), (2, "y", "2", "")]
    assert rows[0].text == "Parameter: x | Value: 1 | Source: s"
    generic = csv_files.generic_rows(files).orderBy("row_index").collect()
    assert [r.fields for r in generic] == [{"Name": "a, b", "Size": "1"}, {"Name": "c", "Size": "2"}]


def test_csv_quotes_line_ends_and_unreadable_files(spark, tmp_path):
    (tmp_path / "q.csv").write_bytes(b'A\tB\r\n"x\ny ""z"""\t1\r\n\r\nlone\r\n1\t2\t3\t4\r\n')
    (tmp_path / "bad.csv").write_bytes(b"Parameter,Value,Source\n\xff\xfe,1,2\n")
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "long.csv").write_text("Parameter,Value,Source\n" + "p," + '"' + "v, " * 60000 + '",s\n')
    files = binary.scan(spark, str(tmp_path), "*.csv")
    generic = csv_files.generic_rows(files).orderBy("row_index").collect()
    assert [r.fields for r in generic] == [{"A": 'x\ny "z"', "B": "1"}, {"A": "lone", "B": None}, {"A": "1", "B": "2", "_rest": "3;4"}]
    rows = csv_files.parameter_rows(files).collect()
    assert [(r.parameter, len(r.value), r.source) for r in rows] == [("p", 179999, "s")]
    assert [r.error for r in csv_files.unreadable(files).collect()] == ["not_utf8"]


def test_uniform_csv(spark, tmp_path):
    (tmp_path / "u.csv").write_text("Parameter,Value,Source\n a ,1,\n,,\nb,2,x\n")
    rows = csv_files.read_uniform_parameters(spark, str(tmp_path)).collect()
    assert [(r.parameter, r.value, r.source) for r in rows] == [("a", "1", ""), ("b", "2", "x")]


def test_binary_scan_and_size_check(spark, tmp_path):
    (tmp_path / "one.bin").write_bytes(b"abc")
    (tmp_path / "two.bin").write_bytes(b"four")
    scanned = binary.scan(spark, str(tmp_path))
    by_name = {r.filename: r for r in scanned.collect()}
    assert by_name["one.bin"].sha256 == hashlib.sha256(b"abc").hexdigest() and by_name["one.bin"].size_bytes == 3
    declared = scanned.select("path", F.lit(3).cast("long").alias("declared_size"))
    good, rejects = binary.check_sizes(scanned, declared)
    assert [r.filename for r in good.collect()] == ["one.bin"] and rejects.count() == 1


def test_mail_parts(spark, tmp_path):
    mail = EmailMessage()
    mail["From"], mail["To"], mail["Subject"], mail["Date"] = "a@x", "b@y", "Höhe", "Wed, 1 Jul 2026 09:00:00 +0000"
    mail.set_content("plain body\n")
    mail.add_attachment(b"%PDF", maintype="application", subtype="pdf", filename="plan.pdf")
    mail.add_attachment(b"img", maintype="image", subtype="png", filename="logo.png", cid="<c1>")
    mail.add_attachment(b"img2", maintype="image", subtype="png", filename="photo.png")
    (tmp_path / "m.eml").write_bytes(bytes(mail))
    html = EmailMessage()
    html.make_mixed()
    part = EmailMessage()
    part.set_content("<p>only html</p>", subtype="html")
    html.attach(part)
    (tmp_path / "h.eml").write_bytes(bytes(html))
    (tmp_path / "old.msg").write_bytes(b"ole")
    files = binary.scan(spark, str(tmp_path))
    rows = email_files.parse_mails(files).filter("path like '%m.eml'").orderBy("part_index").collect()
    assert rows[0].text == "From: a@x\nTo: b@y\nSubject: Höhe\nDate: Wed, 01 Jul 2026 10:00:00 +0100\n"
    assert rows[1].text.strip() == "plain body"
    assert [(r.part_kind, r.filename, r.size_bytes) for r in rows[2:]] == [("attachment", "plan.pdf", 4), ("inline", "logo.png", 3), ("attachment", "photo.png", 4)]

    def body(fallback):
        return email_files.parse_mails(files, fallback).filter("path like '%h.eml' and part_kind = 'body'").first().text

    assert "only html" in body(True) and body(False) == ""
    assert email_files.unreadable(files).count() == 1


def test_parameter_tables_are_one_file_per_item(spark, tmp_path):
    fields = {"Scale": "1:50", "Company": "A, \"B\""}
    answers = spark.createDataFrame([(i, "", fields) for i in ("i1", "i2")], "item_id string, all_text string, fields map<string,string>")
    out = tmp_path / "tables"
    sinks.write_parameter_tables(extraction.report_rows(extraction.canonical_parameters(answers)), str(out))
    for item in ("i1", "i2"):
        written = list((out / f"item_id={item}").glob("*.csv"))
        assert len(written) == 1
        lines = written[0].read_bytes().decode().split("\r\n")
        assert lines[0] == "Parameter,Value,Source" and lines[1].startswith("Email Subject,Not provided")
        assert len([x for x in lines if x]) == 22


def test_log_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "name string, n int")
    sinks.write_log(df.select(ops.log_line("done", F.lit("t"), {"name": F.col("name"), "n": F.col("n")}).alias("line")), str(tmp_path / "log"))
    lines = spark.read.text(str(tmp_path / "log"))
    assert 'design_processing_event={"event":"done","n":null,"name":"b","timestamp":"t"}' in [r.value for r in lines.collect()]
    back = ops.read_log(lines, "event string, name string, n int")
    assert sorted((r.name, r.n) for r in back.collect()) == [("a", 1), ("b", None)]


def write_events(path, batches):
    path.mkdir()
    for i, batch in enumerate(batches):
        (path / f"{i}.json").write_text("\n".join(json.dumps({"received_at": str(t), "payload": json.dumps(p)}) for t, p in batch))


def test_event_stream_keeps_one_row_per_key_across_batches(spark, tmp_path):
    a, b = {"event": {"triggerUuid": "t1", "boardId": 1, "pulseId": 5, "type": "create_item"}}, {"event": {"triggerUuid": "t2", "boardId": 1, "pulseId": 5, "type": "x"}}
    write_events(tmp_path / "in", [[(T, a), (T, a)], [(T + dt.timedelta(minutes=1), a), (T + dt.timedelta(minutes=1), b)]])
    stream = event_source.stream_events(spark, str(tmp_path / "in"), files_per_trigger=1)
    rows = stream_ops.dispatches(stream)
    stream_ops.run_available(rows, str(tmp_path / "cp"), str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.idempotency_key, r.consumer) for r in got) == [(f"trigger:{k}", c) for k in ("t1", "t2") for c in ("auto_sync", "design_processing")]
    batch = ops.first_deliveries(ops.normalize(event_source.read_events(spark, str(tmp_path / "in"))))
    assert sorted(r.idempotency_key for r in batch.collect()) == ["trigger:t1", "trigger:t2"]


def test_for_each_batch_reads_the_current_item(spark, tmp_path):
    moved = {"event": {"triggerUuid": "t1", "pulseId": 5, "groupId": "old"}}
    write_events(tmp_path / "in", [[(T, moved)]])
    stream = event_source.stream_events(spark, str(tmp_path / "in"))
    current = spark.createDataFrame([("5", "new-group", "active", "r")], "item_id string, group_id string, item_state string, source_revision string")
    out = str(tmp_path / "out")

    def decide(batch, batch_id):
        stream_ops.with_current_item(ops.normalize(batch), current).write.mode("overwrite").parquet(f"{out}/{batch_id}")

    stream_ops.for_each_batch(stream, str(tmp_path / "cp"), decide).awaitTermination()
    row = spark.read.parquet(f"{out}/0").first()
    assert (row.group_id, row.current_group_id) == ("old", "new-group")


def test_item_state_stream(spark, tmp_path):
    path = tmp_path / "obs"
    path.mkdir()
    schema = "board_id string, item_id string, seq long, kind string, readiness string, execution_kind string, input_revision string, pipeline_version string"

    def row(seq, kind, readiness=None, execution=None, revision=None):
        return {"board_id": "b", "item_id": "i", "seq": seq, "kind": kind, "readiness": readiness, "execution_kind": execution, "input_revision": revision, "pipeline_version": "p"}

    batches = [
        [row(1, "snapshot", "waiting_for_email"), row(2, "snapshot", "ready", revision="r1"), row(3, "started", execution="analysis", revision="r1")],
        [row(4, "snapshot", "ready", revision="r2"), row(5, "finished"), row(6, "started", execution="analysis", revision="r2"), row(7, "finished")],
        [row(8, "started", execution="publication", revision="r2"), row(9, "finished"), row(10, "snapshot", "ready", revision="r2")],
    ]
    for n, batch in enumerate(batches):
        (path / f"{n}.json").write_text("\n".join(json.dumps(r) for r in batch))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path))
    state.run_item_states(stream, str(tmp_path / "cp"), str(tmp_path / "out")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out/states/batch=2")).orderBy("seq").collect()
    assert [(r.state, r.obligation, r.supersession_requested) for r in rows] == [
        ("waiting_for_email", None, False),
        ("scheduled", "analysis", False),
        ("processing", "analysis", False),
        ("processing", "analysis", True),
        ("processing", "analysis", True),
        ("processing", "analysis", True),
        ("scheduled", "publication", False),
        ("publishing", "publication", False),
        ("ready_for_review", None, False),
        ("ready_for_review", None, False),
    ]


def test_item_states_do_not_depend_on_the_arrival_of_rows(spark):
    rows = [("b", "i", n, "snapshot", "ready", None, f"r{n}", "p") for n in range(5000, 0, -1)]
    schema = "board_id string, item_id string, seq long, kind string, readiness string, execution_kind string, input_revision string, pipeline_version string"
    states = state.item_states(spark.createDataFrame(rows, schema).repartition(7))
    assert states.orderBy(F.col("seq").desc()).first().desired_input_revision == "r5000"


def test_late_and_unreadable_events_are_kept(spark, tmp_path):
    late = [[(T, {"triggerUuid": "a"})], [(T - dt.timedelta(days=400), {"triggerUuid": "late"}), (T, {"triggerUuid": "a"})]]
    write_events(tmp_path / "in", late)
    (tmp_path / "in" / "2.json").write_text("\n".join(json.dumps({"received_at": str(T), "payload": p}) for p in ("{no json", "nor this", None)))
    stream = ops.normalize(event_source.stream_events(spark, str(tmp_path / "in"), files_per_trigger=1))
    stream_ops.run_first_deliveries(stream, str(tmp_path / "cp"), str(tmp_path / "out")).awaitTermination()
    assert sorted(r.idempotency_key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["trigger:a", "trigger:late"]
    rejects = ops.rejected(event_source.read_events(spark, str(tmp_path / "in"))).collect()
    assert sorted(r.reject_reason for r in rejects) == ["missing", "unreadable", "unreadable"]


def test_normalisation_replaces_clashing_columns_and_knows_texts_from_objects(spark):
    rows = [("x", json.dumps({"event": "{no object", "pulseId": 5, "triggerUuid": "t"}), T)]
    got = ops.normalize(spark.createDataFrame(rows, "event_id string, payload string, received_at timestamp")).first()
    assert (got.item_id, got.event_id, got.idempotency_key) == ("5", None, "trigger:t")


def test_every_payload_is_a_delivery_or_a_reject(spark):
    payloads = ['{"a": 1} trailing', '{"a": 1} {"b": 2}', '{"a": 1, "a": 2}', '{"a": NaN}', '{"triggerUuid": "x", "triggerUuid": "y"}', "{'a': 1}",
                '{"triggerUuid": "z"} tail', "[1]", "3", '"t"', "", " ", "null", None, "{", '{"a": ' * 20000]
    rows = spark.createDataFrame([(str(i), p, T) for i, p in enumerate(payloads)], "row string, payload string, received_at timestamp")
    keyed = {r.row for r in ops.normalize(rows).filter("idempotency_key is not null").collect()}
    rejects = {r.row for r in ops.rejected(rows).collect()}
    assert keyed == {"2", "3", "4", "7", "8", "9", "12"} and rejects == {str(i) for i in range(16)} - keyed
    unread = ops.normalize(rows).filter("row = '6'").first()
    assert unread.trigger_uuid is None and unread.idempotency_key is None
    assert ops.normalize(rows).filter("row = '4'").first().idempotency_key in ("trigger:x", "trigger:y")
