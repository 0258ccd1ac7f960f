"""Queries over files and model calls: what Spark derives from the given tables, written and read by the engine's own sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from worklens.operators import models, quality, stage_cache
from worklens.queries import plan_tables as t
from worklens.queries.base import REGISTRY, Proxy, query, stamp, table
from worklens.session import new_shared_path
from worklens.sources import binary, events as event_source, items as item_source

ITEM_FILES = Proxy(
    "orders",
    {
        "id": "cast(o_orderkey as string)",
        "board_id": "case when o_orderkey % 10 = 0 then 'b2' else 'b1' end",
        "group_id": "concat('g', cast(o_custkey % 5 as string))",
        "account": "case when o_custkey % 3 = 0 then '' else concat('a', cast(o_custkey % 4 as string)) end",
        "asset": "concat('x', cast(o_custkey as string))",
    },
)


@query(
    "item_export",
    f"""
    select id as item_id, board_id, group_id, coalesce(nullif(account, ''), 'outside') as account_id,
        coalesce(nullif(account, ''), 'outside') || ':' || board_id || ':' || id as external_task_key, 0 as n_errors, asset as assets
    from {ITEM_FILES.sql}
    """,
)
def item_export(spark, sf):
    """Item documents as an export writes them, scanned with the account known from outside."""
    rows = ITEM_FILES.df(spark, sf)
    document = F.struct(
        "id",
        F.struct(F.col("board_id").alias("id")).alias("board"),
        F.struct(F.col("group_id").alias("id")).alias("group"),
        F.col("account").alias("account_id"),
        F.array(F.struct(F.col("asset").alias("id"))).alias("assets"),
    )
    path = new_shared_path(spark, "item-export")
    rows.select(F.to_json(document).alias("value")).write.text(path)
    found = item_source.read_items(spark, path, "outside")
    assets = found.select(F.col("id").alias("item_id"), F.array_join(F.transform("assets", lambda a: a["id"]), ",").alias("assets"))
    identity = item_source.resolve_identity(found)
    return identity.join(assets, "item_id").select(
        "item_id", "board_id", "group_id", "account_id", "external_task_key", F.size("errors").alias("n_errors"), "assets"
    )


@query(
    "event_files",
    "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as received_at, event_type from events",
)
def event_files(spark, sf):
    """Raw events written as JSON lines and read back as a stream."""
    path = _event_lines(spark, sf)
    streamed = new_shared_path(spark, "event-stream")
    stream = event_source.stream_events(spark, path)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{streamed}/checkpoint").trigger(availableNow=True).start(
        f"{streamed}/data"
    ).awaitTermination()
    return _event_rows(spark.read.parquet(f"{streamed}/data"))


@query(
    "event_file_table",
    "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as received_at, event_type from events",
)
def event_file_table(spark, sf):
    """Raw events written as JSON lines and read back as a table."""
    return _event_rows(event_source.read_events(spark, _event_lines(spark, sf)))


def _event_lines(spark, sf):
    e = table(spark, sf, "events")
    path = new_shared_path(spark, "event-files")
    payload = F.to_json(F.struct("event_id", "event_type"))
    e.select(F.col("ts").cast("timestamp").alias("received_at"), payload.alias("payload")).write.json(path)
    return path


def _event_rows(read):
    return read.select(
        F.get_json_object("payload", "$.event_id").cast("long").alias("event_id"),
        stamp("received_at").alias("received_at"),
        F.get_json_object("payload", "$.event_type").alias("event_type"),
    )


@query(
    "checked_sizes",
    """
    select s_nationkey as nation, sum(strlen(s_name) + 1)::bigint as size_bytes,
        case when s_nationkey % 3 = 0 then 'size_mismatch' else 'ok' end as verdict
    from supplier group by 1
    """,
)
def checked_sizes(spark, sf):
    """One file per nation; every third declared size is wrong."""
    names = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("value"))
    path = new_shared_path(spark, "sized-files")
    names.repartition("nation").write.partitionBy("nation").text(path)
    scanned = binary.scan(spark, path, "*.txt")
    nation = F.regexp_extract("path", "nation=([0-9]+)", 1).cast("int")
    sizes = names.groupBy("nation").agg(F.sum(F.octet_length("value") + 1).alias("size"))
    declared = scanned.select("path", nation.alias("nation")).join(sizes, "nation").select(
        "path", F.when(F.col("nation") % 3 == 0, F.lit(-1)).otherwise(F.col("size")).alias("declared_size")
    )
    kept, rejects = binary.check_sizes(scanned, declared)
    kept = kept.select("path", "size_bytes", F.lit("ok").alias("verdict"))
    rows = kept.unionByName(rejects.select("path", "size_bytes", F.col("error").alias("verdict")))
    return rows.select(nation.alias("nation"), "size_bytes", "verdict")


_IDENTITY = ["board_id", "item_id", "column_id", "artifact_kind", "input_revision", "pipeline_version"]


@query(
    "metadata_conflicts",
    f"""
    with r as (
        select {", ".join(_IDENTITY)}, min(deterministic_filename) as name, min(size_bytes) as size from {t.ARTIFACTS.sql} group by all
    )
    select a.id from {t.ARTIFACTS.sql} a join r using ({", ".join(_IDENTITY)})
    where a.status in ('rendered', 'published')
        and (a.deterministic_filename is distinct from r.name or a.size_bytes is distinct from r.size)
    """,
)
def metadata_conflicts(spark, sf):
    """Stored artifacts against one new rendering of their identity."""
    stored = t.ARTIFACTS.df(spark, sf).withColumn("content_sha256", F.lit("h"))
    rendered = stored.groupBy(*_IDENTITY).agg(
        F.min("deterministic_filename").alias("deterministic_filename"),
        F.lit("h").alias("content_sha256"),
        F.min("size_bytes").alias("size_bytes"),
    )
    return quality.metadata_conflicts(stored, rendered).select("id")


@query(
    "model_embeddings",
    """
    with v as (select doc_id, strlen(text)::double as a, length(text)::double as b from documents)
    select doc_id, round(coalesce(a / nullif(sqrt(a * a + b * b), 0), 0), 2) as x,
        round(coalesce(b / nullif(sqrt(a * a + b * b), 0), 0), 2) as y from v
    """,
)
def model_embeddings(spark, sf):
    """Vectors from a client of the caller's, made once per task and called in batches; empty texts have the zero vector."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return _two_numbers(models.embed_with(docs, _size_client, "text", "embedding", batch_size=16))


def _size_client():
    return lambda texts: [[float(len(t.encode())), float(len(t))] for t in texts]


def _two_numbers(rows):
    return rows.select("doc_id", *(F.round(F.col("embedding")[i].cast("double"), 2).alias(c) for i, c in enumerate("xy")))


@query("cached_embeddings", REGISTRY["model_embeddings"][1])
def cached_embeddings(spark, sf):
    """Two runs with one cache: the second gives the model only what the first, over one source, had not seen."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source")
    path = new_shared_path(spark, "embedding-cache")

    def embed(rows):
        return models.embed_with(rows, _size_client, "text", "embedding", batch_size=16)

    first = docs.agg(F.min("source")).first()[0]
    stage_cache.cached(docs.filter(F.col("source").eqNullSafe(first)), "text", "sizes-1", path, embed)
    return _two_numbers(stage_cache.cached(docs, "text", "sizes-1", path, embed))


@query(
    "model_plans",
    """
    select conv_id, turn, case when turn % 3 = 1 then null else role || '|' || upper(role) end as queries, turn % 3 = 2 as third
    from conversations
    """,
)
def model_plans(spark, sf):
    """Plans from a planner of the caller's; one that fails leaves no queries."""

    def make_planner():
        def plan(question: str) -> dict:
            turn, role = question.split(" ", 1)
            if int(turn) % 3 == 1:
                raise ValueError("no plan")
            return {"search_queries": [role, role.upper()], "third_search_justified": int(turn) % 3 == 2}

        return plan

    asked = table(spark, sf, "conversations").select(
        F.struct("conv_id", "turn").alias("request_id"), F.concat(F.col("turn").cast("string"), F.lit(" "), "role").alias("question")
    )
    asked = asked.withColumn("request_id", F.concat_ws("/", "request_id.conv_id", "request_id.turn"))
    plans = models.plan_with(asked, make_planner)
    parts = F.split("request_id", "/")
    return plans.select(
        parts[0].cast("long").alias("conv_id"),
        parts[1].cast("long").alias("turn"),
        F.array_join("search_queries", "|").alias("queries"),
        F.col("third_search_justified").alias("third"),
    )
