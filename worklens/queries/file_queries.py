"""Queries over files that Spark derives from the given tables, and their ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from worklens import vocab
from worklens.functions import keys
from worklens.operators import ingest, routing
from worklens.queries.base import Proxy, query, sql_strip, table
from worklens.session import new_shared_path
from worklens.sources import binary, csv_files, email_files, sinks
from worklens.streaming import events as stream_ops, keyed_state, state

ROWS_PER_FILE = 200


@query(
    "parameter_files",
    f"""
    with r as (select c_custkey // {ROWS_PER_FILE} as file, c_name as parameter, c_mktsegment || ', "' || c_nationkey || '"' as value, row_number() over (partition by c_custkey // {ROWS_PER_FILE} order by c_custkey % 7, c_name) as n from customer)
    select file::varchar as file, n::int as row_index, parameter, value, 'board' as source, 'Parameter: ' || parameter || ' | Value: ' || value || ' | Source: board' as text from r
    """,
)
def parameter_files(spark, sf):
    """Parameter tables written by the sink, then scanned and read back."""
    rows = table(spark, sf, "customer").select(
        F.floor(F.col("c_custkey") / ROWS_PER_FILE).alias("file"),
        (F.col("c_custkey") % 7).alias("seq"),
        F.col("c_name").alias("parameter"),
        F.concat("c_mktsegment", F.lit(', "'), F.col("c_nationkey").cast("string"), F.lit('"')).alias("value"),
        F.lit("board").alias("source"),
    )
    path = new_shared_path(spark, "parameter-files")
    sinks.write_parameter_tables(rows, path, "file")
    found = csv_files.parameter_rows(binary.scan(spark, path, "*.csv"))
    return found.withColumn("file", F.regexp_extract("path", "file=([0-9]+)", 1)).drop("path")


@query(
    "named_parameter_files",
    f"""
    with r as (select c_custkey // {ROWS_PER_FILE} as file, c_name as parameter, c_mktsegment || ', "' || c_nationkey || '"' as value, row_number() over (partition by c_custkey // {ROWS_PER_FILE} order by c_custkey % 7, c_name) as n from customer)
    select 'AI_Data_' || file || '_' || substring(sha256(file::varchar), 1, 12) || '_' || substring(sha256('p'), 1, 12) || '.csv' as filename, n::int as row_index, parameter, value from r
    """,
)
def named_parameter_files(spark, sf):
    """Parameter tables under the names of their artifacts, read back file by file."""
    file = F.floor(F.col("c_custkey") / ROWS_PER_FILE).cast("string")
    rows = table(spark, sf, "customer").select(
        keys.artifact_filenames(file, keys.digest(file), F.lit("p"))["ai_data"].alias("filename"),
        (F.col("c_custkey") % 7).alias("seq"),
        F.col("c_name").alias("parameter"),
        F.concat("c_mktsegment", F.lit(', "'), F.col("c_nationkey").cast("string"), F.lit('"')).alias("value"),
        F.lit("board").alias("source"),
    )
    path = new_shared_path(spark, "named-files")
    sinks.write_parameter_files(rows, path)
    found = csv_files.parameter_rows(binary.scan(spark, path, "*.csv"))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "row_index", "parameter", "value")


@query(
    "mail_files",
    f"""
    with c as (select conv_id, string_agg(text, chr(10) order by turn) as body from conversations group by 1)
    select conv_id::varchar as conv_id, 'From: a@x' || chr(10) || 'To: b@y' || chr(10) || 'Subject: Conversation ' || conv_id || chr(10) || 'Date: Wed, 01 Jul 2026 10:00:00 +0100' || chr(10) as header,
      md5({sql_strip('body')}) as body_md5 from c
    """,
)
def mail_files(spark, sf):
    """One mail file per conversation, written by Spark and parsed again."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("value"))
    head = F.array(
        F.lit("From: a@x"),
        F.lit("To: b@y"),
        F.concat(F.lit("Subject: Conversation "), F.col("conv_id").cast("string")),
        F.lit("Date: Wed, 1 Jul 2026 09:00:00 +0000"),
        F.lit("MIME-Version: 1.0"),
        F.lit("Content-Type: text/plain; charset=utf-8"),
        F.lit("Content-Transfer-Encoding: 8bit"),
        F.lit(""),
    )
    first = turns.select("conv_id").distinct().select("conv_id", F.posexplode(head).alias("pos", "value"))
    lines = first.select("conv_id", (F.col("pos") - 100).cast("long").alias("turn"), "value").unionByName(turns)
    path = new_shared_path(spark, "mail-files")
    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    ordered.select("conv_id", "value").write.partitionBy("conv_id").text(path)
    parts = email_files.parse_mails(binary.scan(spark, path, "*.txt"))
    by_mail = parts.withColumn("conv_id", F.regexp_extract("path", "conv_id=([0-9]+)", 1)).groupBy("conv_id")
    return by_mail.agg(
        F.max(F.when(F.col("part_kind") == "header", F.col("text"))).alias("header"),
        F.max(F.when(F.col("part_kind") == "body", F.md5(F.btrim("text", F.lit(" \n\r\t"))))).alias("body_md5"),
    )


ASSETS = Proxy(
    "documents",
    {
        "file_id": "doc_id",
        "item_id": "source",
        "path": "cast(doc_id as string)",
        "filename": "case lang when 'en' then 'Plan.pdf' when 'de' then 'photo.png' when 'fr' then 'table.csv' else 'scan.GIF' end",
        "actual_size": "case when doc_id % 7 = 0 then n_chars * 1000000 else n_chars end",
        "content": "text",
    },
)
_PLACE = """case when lang = 'es' then 'Unsupported image format: gif'
    when lang = 'en' and size > 31457280 then 'PDF too large for extraction (' || size || ' bytes).'
    when lang = 'de' and size > 10485760 then 'Image too large for extraction (' || size || ' bytes).' else text end"""


@query(
    "ingest_run",
    f"""
    with a as (select *, case when doc_id % 7 = 0 then n_chars * 1000000 else n_chars end as size from documents),
    d as (select doc_id as file_id, case lang when 'en' then 'pdf' when 'fr' then 'csv' else 'image' end as kind,
        case lang when 'en' then null when 'fr' then 'row:1' else 'image:description' end as section, {sql_strip(f'({_PLACE})')} as t from a where case when doc_id % 7 = 0 then n_chars * 1000000 else n_chars end <= 50000000),
    n as (select *, greatest(1, ceil((length(t) - 150) / 850.0))::int as total from d where t <> ''), c as (select *, unnest(range(0, total)) as i from n)
    select file_id, kind, case when section is null then 'chunk:' || (i + 1) when total > 1 then section || ':chunk:' || (i + 1) else section end as section,
      md5(substring(t, (i * 850 + 1)::bigint, 1000)) as chunk_md5 from c
    """,
)
def ingest_run(spark, sf):
    """Route, extract or replace by a placeholder, and cut: the whole ingest of one run."""
    rows = ASSETS.df(spark, sf)
    routed = rows.withColumn("route", routing.route("filename", F.lit(""), F.lit("attachment"), "actual_size", vocab.MAX_OBJECT_BYTES))
    extracted = rows.select("path", F.lit(None).cast("string").alias("attachment"), F.col("content").alias("text"))
    csv = rows.select("path", F.lit(1).alias("row_index"), F.col("content").alias("text"))
    no_mails = spark.createDataFrame(
        [], "path string, part_kind string, filename string, text string, size_bytes long, part_index int"
    )
    no_items = spark.createDataFrame(
        [],
        "item_id string, column_values array<struct<column:struct<title:string>,value:string,text:string,display_value:string>>",
    )
    documents = ingest.ingest_documents(
        routed.drop("content"), csv, no_mails, extracted, no_items, max_pdf_bytes=vocab.MAX_PDF_BYTES, max_image_bytes=vocab.MAX_IMAGE_BYTES
    )
    chunks = ingest.chunk_documents(documents)
    return chunks.select(F.col("file_id").cast("long").alias("file_id"), "kind", "section", F.md5("chunk_text").alias("chunk_md5"))


@query(
    "snapshot_documents",
    f"""
    with texts as (
        select source as item, case lang when 'en' then 'pdf' when 'fr' then 'csv' else 'image' end as kind,
            case when lang in ('de', 'en', 'fr') then text else 'Unsupported image format: gif' end as t from documents
        union all select 'src' || (conv_id % 20), 'email', 'From: ' || conv_id from conversations where turn = 0
        union all select 'src' || (conv_id % 20), 'email', text from conversations where turn = 0
        union all select 'src' || (conv_id % 20), 'pdf', 'PDF ATTACHMENT (turn' || turn || '.pdf):' || chr(10) || text from conversations
        union all select distinct source, 'monday_columns', 'Column: TP Ref | Value: ' || source from documents
    ),
    n as (select item, kind, length({sql_strip('t')}) as n from texts where {sql_strip('t')} <> ''),
    c as (select item, kind, count(*) as docs, sum(greatest(1, ceil((n - 150) / 850.0)))::bigint as chunks from n group by all)
    select item as item_id, sum(docs)::bigint as total_docs, sum(chunks)::bigint as total_chunks,
        string_agg(kind || '=' || docs, ',' order by kind) as by_kind, 'complete' as ingestion_status
    from c group by 1
    """,
)
def snapshot_documents(spark, sf):
    """A whole ingest: files, CSV rows, mails with attachments and board columns, ending in the completed snapshots."""
    files = ASSETS.df(spark, sf)
    turns = table(spark, sf, "conversations")
    mail_path = F.concat(F.lit("mail-"), F.col("conv_id").cast("string"))
    mail_item = F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string"))
    mails = turns.filter("turn = 0").select(
        (-F.col("conv_id") - 1).alias("file_id"), mail_item.alias("item_id"), mail_path.alias("path"), F.lit("m.eml").alias("filename"), F.lit(1).cast("long").alias("actual_size")
    )
    assets = files.drop("content").unionByName(mails)
    assets = assets.withColumn("route", routing.route("filename", F.lit(""), F.lit("attachment"), "actual_size"))
    size = F.length("text").cast("long").alias("size_bytes")
    name = F.concat(F.lit("turn"), F.col("turn").cast("string"), F.lit(".pdf"))
    none = F.lit(None).cast("string")
    head = turns.filter("turn = 0")
    parts = (
        head.select(mail_path.alias("path"), F.lit("header").alias("part_kind"), none.alias("filename"), F.concat(F.lit("From: "), F.col("conv_id").cast("string")).alias("text"), F.lit(None).cast("long").alias("size_bytes"), F.lit(0).alias("part_index"))
        .unionByName(head.select(mail_path.alias("path"), F.lit("body").alias("part_kind"), none.alias("filename"), "text", F.lit(None).cast("long").alias("size_bytes"), F.lit(1).alias("part_index")))
        .unionByName(turns.select(mail_path.alias("path"), F.lit("attachment").alias("part_kind"), name.alias("filename"), none.alias("text"), size, (F.col("turn") + 2).cast("int").alias("part_index")))
    )
    extracted = files.select("path", none.alias("attachment"), F.col("content").alias("text")).unionByName(
        turns.select(mail_path.alias("path"), name.alias("attachment"), "text")
    )
    csv = files.select("path", F.lit(1).alias("row_index"), F.col("content").alias("text"))
    sources = files.select("item_id").distinct()
    value = F.struct(F.struct(F.lit("TP Ref").alias("title")).alias("column"), none.alias("value"), F.col("item_id").alias("text"), none.alias("display_value"))
    items = sources.select("item_id", F.array(value).alias("column_values"))
    documents = ingest.ingest_documents(assets, csv, parts, extracted, items)
    done = ingest.complete_snapshots(sources, documents, F.lit("2024-01-01").cast("timestamp"))
    kinds = F.transform(F.map_entries("extracted_docs_summary.by_kind"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return done.select(
        "item_id", "extracted_docs_summary.total_docs", "extracted_docs_summary.total_chunks", F.array_join(F.array_sort(kinds), ",").alias("by_kind"), "ingestion_status"
    )


@query(
    "derived_attachments",
    """
    select p_partkey, 'derived:' || p_partkey || ':' || substring(sha256(p_name), 1, 12) || ':' || regexp_replace(p_name, '[^A-Za-z0-9._-]+', '_', 'g') || '.pdf' as asset_id,
      case when p_size % 2 = 0 then 'attachment_image' else 'attachment_pdf' end as kind from part
    """,
)
def derived_attachments(spark, sf):
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("path"),
        F.when(F.col("p_size") % 2 == 0, F.lit("inline")).otherwise("attachment").alias("part_kind"),
        F.concat("p_name", F.lit(".pdf")).alias("filename"),
        F.lit("application/pdf").alias("mime_type"),
        F.lit(1).cast("long").alias("size_bytes"),
        F.sha2("p_name", 256).alias("sha256"),
    )
    rows = ingest.derived_files(parts, F.col("path"))
    return rows.select(F.col("path").cast("long").alias("p_partkey"), "asset_id", "kind")


OBSERVATIONS = Proxy(
    "events",
    {
        "board_id": "'b'",
        "item_id": "cast(user_id as string)",
        "seq": "event_id",
        "kind": "case event_type when 'click' then 'started' when 'purchase' then 'finished' else 'snapshot' end",
        "readiness": "case event_type when 'signup' then 'waiting_for_email' else 'ready' end",
        "execution_kind": "case when event_id % 2 = 0 then 'analysis' else 'publication' end",
        "input_revision": "case when event_type <> 'signup' then concat('r', cast(cast(floor(value) as bigint) % 2 as string)) end",
        "pipeline_version": "'p'",
    },
)
_PAIR = "case when input_revision is not null then input_revision || '/' || pipeline_version end"


_WALK = f"""
    with recursive o as materialized (
        select *, row_number() over (partition by item_id order by seq) as i, {_PAIR} as pair,
            case when readiness = 'ready' then {_PAIR} end as ready_pair from {OBSERVATIONS.sql}
    ),
    walk(item_id, i, seq, state, desired, analyzed, published, running, running_kind, superseded) as (
        select distinct item_id, 0::bigint, null::bigint, 'scheduled', null::varchar, null::varchar, null::varchar, null::varchar,
            null::varchar, false from o
        union all
        select o.item_id, o.i, o.seq,
            case when o.kind = 'snapshot' then case
                    when o.readiness <> 'ready' then o.readiness
                    when w.desired is distinct from o.ready_pair and o.ready_pair is not null and o.ready_pair is distinct from w.published
                        then case when w.running is null then 'scheduled' when w.running_kind = 'publication' then 'publishing' else 'processing' end
                    when w.desired is distinct from o.ready_pair and w.state in ('waiting_for_name', 'waiting_for_email', 'ineligible', 'failed')
                        then 'scheduled'
                    else w.state end
                when o.kind = 'started' then case o.execution_kind when 'publication' then 'publishing' else 'processing' end
                when w.running = w.desired then case w.running_kind when 'publication' then 'ready_for_review' else 'scheduled' end
                else w.state end,
            case when o.kind = 'snapshot' then o.ready_pair else w.desired end,
            case when o.kind = 'finished' and w.running = w.desired and w.running_kind = 'analysis' then w.running else w.analyzed end,
            case when o.kind = 'finished' and w.running = w.desired and w.running_kind = 'publication' then w.running else w.published end,
            case o.kind when 'started' then o.pair when 'finished' then null else w.running end,
            case o.kind when 'started' then o.execution_kind when 'finished' then null else w.running_kind end,
            case when o.kind = 'snapshot' and w.desired is distinct from o.ready_pair and w.running is not null
                    and w.running is distinct from o.ready_pair then true
                when o.kind = 'finished' and w.running = w.desired then false else w.superseded end
        from walk w join o on o.item_id = w.item_id and o.i = w.i + 1
    )
    select 'b' as board_id, item_id, seq, state, split_part(desired, '/', 1) as desired_input_revision,
        split_part(desired, '/', 2) as desired_pipeline_version,
        case when desired is null then null when desired is distinct from analyzed then 'analysis'
            when desired is distinct from published then 'publication' end as obligation, superseded as supersession_requested
    from walk where i > 0
    """


@query("stream_item_states", _WALK)
def stream_item_states(spark, sf):
    """Observations arrive out of order, newest files first; every item ends with the states of its ordered history."""
    rows = OBSERVATIONS.df(spark, sf)
    out = new_shared_path(spark, "item-states")
    rows.repartitionByRange(4, F.col("seq").desc()).write.parquet(f"{out}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{out}/in")
    state.run_item_states(stream, f"{out}/checkpoint", f"{out}/data").awaitTermination()
    # The last batch that touched an item knows all of its observations.
    states = spark.read.parquet(f"{out}/data/states")
    final = states.groupBy("board_id", "item_id").agg(F.max("batch").alias("batch"))
    return states.join(final, ["board_id", "item_id", "batch"]).drop("batch")


@query("keyed_item_states", _WALK)
def keyed_item_states(spark, sf):
    """Twelve micro-batches in no order, with the history of each item in slices of the state store."""
    rows = OBSERVATIONS.df(spark, sf)
    out = new_shared_path(spark, "keyed-states")
    rows.repartition(12, F.xxhash64("seq")).write.parquet(f"{out}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    keyed_state.run_keyed_item_states(stream, f"{out}/checkpoint", f"{out}/data", slice_size=16).awaitTermination()
    return keyed_state.current_states(spark, f"{out}/data")
