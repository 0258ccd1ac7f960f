"""Queries over retrieval: plans, exact search, evidence, citations, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from worklens import vocab
from worklens.operators import ingest, models, near_search, retrieval
from worklens.queries.base import Proxy, query, sql_collapse, sql_limited, sql_strip, table
from worklens.session import written

PLANS = Proxy(
    "conversations",
    {
        "conv_id": "conv_id",
        "turn": "turn",
        "question": "text",
        "lowered": "lower(text)",
        "role": "role",
        "kind": "turn % 5",
    },
)
_Q, _L = sql_collapse("question"), sql_collapse("lowered")


@query(
    "retrieval_plans",
    f"""
    with p as (select *, {_Q} as q, {_L} as l from {PLANS.sql})
    select conv_id, turn, case kind when 0 then q when 1 then '' when 2 then q
      when 3 then concat_ws('|', nullif(l, ''), case when lower(l) <> 'x ' || role then 'X ' || role end)
      else concat_ws('|', nullif(q, ''), role, 'third one') end as queries from p
    """,
)
def retrieval_plans(spark, sf):
    p = PLANS.df(spark, sf)
    blank = F.lit(" \n")
    queries = (
        F.when(F.col("kind") == 1, F.array().cast("array<string>"))
        .when(F.col("kind") == 2, F.array(blank, F.lit("")))
        .when(F.col("kind") == 3, F.array("lowered", "question", F.concat(F.lit(" X\t"), "role"), F.lit("never")))
        .when(F.col("kind") == 4, F.array("question", "role", blank, "role", F.lit("third  one"), F.lit("fourth")))
    )
    p = p.withColumn("search_queries", queries).withColumn("third_search_justified", F.col("kind") == 4)
    # The shown feature includes the limits of a plan.
    plan = retrieval.sanitize_plan(limit=vocab.MAX_QUERIES, compound_limit=vocab.MAX_COMPOUND_QUERIES)
    return p.select("conv_id", "turn", F.array_join(plan, "|").alias("queries"))


# Every label asks with its first vector; two scopes split the vectors.
_ASKED = """select label, arg_min(embedding, vec_id)::double[] as q, min(vec_id) as first from embeddings group by 1"""


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    scope = F.when(F.col("label") % 3 == 0, F.lit("small")).otherwise("large")
    chunks = e.select(scope.alias("external_task_key"), F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").cast("string").alias("file_id"))
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"))
    queries = first.select(
        scope.alias("external_task_key"),
        F.concat(F.lit("r"), (F.col("label") % 5).cast("string"), scope).alias("request_id"),
        F.floor(F.col("label") / 5).cast("int").alias("query_index"),
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("matched_query"),
        "vector",
    )
    return chunks, queries


_TOP_K = f"""
    with a as ({_ASKED}),
    d as (select a.label, e.vec_id, 1 - list_dot_product(a.q, e.embedding::double[]) / (sqrt(list_dot_product(a.q, a.q)) * sqrt(list_dot_product(e.embedding::double[], e.embedding::double[]))) as d
      from a join embeddings e on (a.label % 3 = 0) = (e.label % 3 = 0)),
    r as (select *, row_number() over (partition by label order by d, vec_id) as rn from d)
    select 'r' || (label % 5) || case when label % 3 = 0 then 'small' else 'large' end as request_id, (label // 5)::int as query_index, vec_id as chunk_id, round(d, 6) + 0.0 as score, rn::int as cand_pos
    from r where rn <= 8
    """


@query("vector_top_k", _TOP_K)
def vector_top_k(spark, sf):
    chunks, queries = _vectors(spark, sf)
    found = retrieval.search(chunks, queries)
    # Adding zero turns a rounded -0.0 into 0.0.
    return found.select("request_id", "query_index", "chunk_id", (F.round("score", 6) + 0.0).alias("score"), "cand_pos")


@query("vector_near_search", _TOP_K)
def vector_near_search(spark, sf):
    """The exact search by cells: what the first cells leave open is looked up as far as the bound asks."""
    chunks, queries = _vectors(spark, sf)
    found = near_search.near_search(chunks, queries, 8, cells=16, probes=2)
    return found.select("request_id", "query_index", "chunk_id", (F.round("score", 6) + 0.0).alias("score"), "cand_pos")


@query(
    "vector_near_recall",
    f"select request_id, query_index, true as recalled from ({_TOP_K}) group by 1, 2",
)
def vector_near_recall(spark, sf):
    """Whether a few cells alone find at least 0.9 of each query's exact answer, on the average of all queries."""
    chunks, queries = _vectors(spark, sf)
    near = near_search.near_search(chunks, queries, 8, cells=16, probes=12, exact=False).select("request_id", "query_index", "chunk_id", F.lit(1).alias("hit"))
    exact = written(retrieval.search(chunks, queries).join(near, ["request_id", "query_index", "chunk_id"], "left"), "near-recall")
    recall = exact.agg(F.count("hit") / F.count(F.lit(1))).first()[0]
    return exact.select("request_id", "query_index", F.lit(recall >= 0.9).alias("recalled")).distinct()


@query(
    "diverse_evidence",
    f"""
    with recursive found as materialized (
        select t.*, e.label::varchar as file_id, 'label ' || (query_index * 5 + substring(request_id, 2, 1)::int) as matched_query
        from ({_TOP_K}) t join embeddings e on e.vec_id = t.chunk_id
    ),
    buckets as materialized (
        select request_id, query_index, list({{'c': chunk_id, 'f': file_id, 'q': query_index, 'm': matched_query}} order by cand_pos, chunk_id) as rows,
            row_number() over (partition by request_id order by query_index) - 1 as place
        from found group by request_id, query_index
    ),
    asked as materialized (select request_id, count(*) as n from buckets group by 1),
    walk as (
        select request_id, n, 0 as turn, []::struct(c bigint, f varchar, q int, m varchar)[] as picked from asked
        union all
        select w.request_id, n, turn + 1, case when len(picked) >= {vocab.MAX_EVIDENCE} then picked else list_concat(picked, list_filter(rows,
            lambda x: len(list_filter(picked, lambda p: p.c = x.c)) = 0
                and len(list_filter(picked, lambda p: p.f = x.f)) < {vocab.MAX_PER_FILE})[1:1]) end
        from walk w join buckets b on b.request_id = w.request_id and b.place = turn % n
        where turn < n * {vocab.MAX_EVIDENCE}
    ),
    last as (select request_id, picked from walk where turn = n * {vocab.MAX_EVIDENCE}),
    placed as (select request_id, unnest(picked) as x, unnest(range(1, len(picked) + 1)) as position from last)
    select p.request_id, position::int as position, x.c as chunk_id, x.f as file_id, x.q as selected_by_index, x.m as selected_by_query,
        min(f.score) as score, string_agg(distinct f.query_index::varchar, ',' order by f.query_index::varchar) as matched_query_indexes
    from placed p join found f on f.request_id = p.request_id and f.chunk_id = x.c group by all
    """,
)
def diverse_evidence(spark, sf):
    """The flagship: which passages are the best evidence for each request?"""
    chunks, queries = _vectors(spark, sf)
    found = retrieval.search(chunks, queries)
    candidates = (
        found.join(queries.drop("vector", "external_task_key"), ["request_id", "query_index"])
        .join(chunks.select("chunk_id", "file_id"), "chunk_id")
        .withColumn("filename", F.concat(F.lit("file "), "file_id"))
    )
    evidence = retrieval.diverse_evidence(candidates)
    return evidence.select(
        "request_id",
        "position",
        "chunk_id",
        "file_id",
        "selected_by_index",
        "selected_by_query",
        (F.round("score", 6) + 0.0).alias("score"),
        F.array_join(F.col("matched_query_indexes").cast("array<string>"), ",").alias("matched_query_indexes"),
    )


CANDIDATES = Proxy(
    "events",
    {
        "request_id": "user_id",
        "chunk_id": "event_type",
        "query_index": "cast(event_id % 3 as int)",
        "cand_pos": "event_id",
        "matched_query": "concat('q', cast(event_id % 3 as string))",
        "score": "case when event_id % 10 = 0 then cast(null as double) else cast(cast(floor(value) as int) % 5 as double) end",
        "file_id": "cast(event_id % 4 as string)",
        "filename": "cast(event_id as string)",
    },
)


@query(
    "candidate_merge",
    f"""
    with c as (select *, coalesce(score, 1e300) as s from {CANDIDATES.sql}),
    b as (select request_id, chunk_id, arg_min(filename, (s, query_index, cand_pos)) as filename, arg_min(coalesce(score, -1), (s, query_index, cand_pos)) as score from c group by 1, 2),
    h as (select request_id, chunk_id, query_index, min(cand_pos) as p from c group by 1, 2, 3)
    select b.request_id, b.chunk_id, b.filename, b.score, (select string_agg(query_index::varchar, ',' order by query_index, p) from h where h.request_id = b.request_id and h.chunk_id = b.chunk_id) as matched_query_indexes from b
    """,
)
def candidate_merge(spark, sf):
    merged = retrieval.merge_candidates(CANDIDATES.df(spark, sf))
    return merged.select(
        "request_id",
        "chunk_id",
        "filename",
        F.coalesce("score", F.lit(-1.0)).alias("score"),
        F.array_join(F.col("matched_query_indexes").cast("array<string>"), ",").alias("matched_query_indexes"),
    )


EVIDENCE = Proxy(
    "conversations",
    {
        "request_id": "conv_id",
        "position": "cast(turn + 1 as int)",
        "chunk_id": "concat(role, cast(turn as string))",
        "filename": "case when role = 'user' then 'Mail.MSG' else 'plan.pdf' end",
        "section": "case when turn % 2 = 0 then concat('email:body:chunk:', cast(turn as string)) else 'chunk:1' end",
        "snippet": "case when turn % 3 = 0 then concat(' ', text, chr(10), 'Confidentiality notice', chr(10), 'x') else text end",
        "score": "cast(turn as double)",
        "matched_queries": "role",
        "selected_by_query": "role",
    },
)
_CITED = ["user2", "none", "assistant1", "user2", "system0", "user0", "assistant3", "user4", "assistant5", "user6", "assistant7"]
_NOTICE = "(?ims)(?:" + "|".join(vocab.DISCLAIMER_PATTERNS) + ").*"
_SNIPPET = f"case when section like 'email:%' or filename = 'Mail.MSG' then {sql_strip(f'''regexp_replace({sql_strip('snippet')}, '{_NOTICE}', '')''')} else {sql_strip('snippet')} end"


def _cited(spark, sf):
    ids = F.array(*[F.lit(c) for c in _CITED])
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("request_id")).distinct().withColumn("cited_chunk_ids", ids)


@query(
    "cited_sources",
    f"select request_id, chunk_id, 'S' || position as source_id, (list_position({_CITED}, chunk_id) - 1)::int as cited_pos from {EVIDENCE.sql} where list_contains({_CITED}, chunk_id)",
)
def cited_sources(spark, sf):
    rows = retrieval.cited_evidence(EVIDENCE.df(spark, sf), _cited(spark, sf))
    return rows.select("request_id", "chunk_id", "source_id", "cited_pos")


@query(
    "citations_for_display",
    f"""
    with c as (select *, 'S' || position as source_id, row_number() over (partition by request_id order by list_position({_CITED}, chunk_id)) as n from {EVIDENCE.sql} where list_contains({_CITED}, chunk_id))
    select request_id, source_id, n::int as display_pos, regexp_replace(section, '^(.*):chunk:[0-9]+$', '\\1') as section, md5({_SNIPPET}) as snippet_md5 from c where n <= 6
    """,
)
def citations_for_display(spark, sf):
    rows = retrieval.citations_for_display(retrieval.cited_evidence(EVIDENCE.df(spark, sf), _cited(spark, sf)), vocab.MAX_CITATIONS)
    return rows.select("request_id", "source_id", "display_pos", "section", F.md5("snippet").alias("snippet_md5"))


@query(
    "evidence_payload",
    f"with s as (select request_id, position, {_SNIPPET} as t from {EVIDENCE.sql}) select request_id, 'S' || position as source_id, md5({sql_limited('t', 1800)}) as snippet_md5 from s",
)
def evidence_payload(spark, sf):
    rows = retrieval.evidence_payload(EVIDENCE.df(spark, sf), max_chars=1800)
    return rows.select("request_id", "source_id", F.md5("snippet").alias("snippet_md5"))


@query(
    "fallback_answers",
    f"""
    with s as (select request_id, position, {_SNIPPET} as t from {EVIDENCE.sql} where position <= 3),
    e as (select request_id, string_agg({sql_limited('t', 260)}, ' | ' order by position) as x from s where t <> '' group by 1),
    r as (select distinct conv_id as request_id, conv_id % 2 = 0 as wide, conv_id % 3 > 0 as has from conversations)
    select r.request_id, md5(concat_ws(chr(10) || chr(10), '{vocab.FALLBACK_OPENING}', case when wide then '{vocab.FALLBACK_PARTIAL}' end,
      case when has then 'Task details: id: ' || r.request_id || '; name: n; c: 3; d: 4; e: 5' end, 'Relevant source excerpts: ' || e.x,
      case when not has and e.x is null then '{vocab.FALLBACK_NOTHING}' end)) as answer_md5 from r left join e using (request_id)
    """,
)
def fallback_answers(spark, sf):
    def detail(key, value):
        return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))

    given = F.array(
        detail("id", F.col("request_id")),
        detail("skipped", F.lit("")),
        detail("name", F.lit("n")),
        detail("none", F.lit(None)),
        detail("list", F.lit("[]")),
        *[detail(k, F.lit(v)) for k, v in (("c", "3"), ("d", "4"), ("e", "5"), ("f", "6"))],
    )
    requests = table(spark, sf, "conversations").select(F.col("conv_id").alias("request_id")).distinct()
    empty = F.array(detail("x", F.lit("{}")))
    requests = requests.select(
        "request_id",
        (F.col("request_id") % 2 == 0).alias("corpus_wide_requested"),
        F.when(F.col("request_id") % 3 > 0, given).otherwise(empty).alias("context"),
    )
    rows = retrieval.fallback_answers(
        requests, EVIDENCE.df(spark, sf), details_shown=5, excerpts_shown=3, detail_chars=220, excerpt_chars=260
    )
    return rows.select("request_id", F.md5("answer").alias("answer_md5"))


def _chunk_tables(spark, sf):
    """Documents as files of one snapshot per source, cut and embedded offline."""
    documents = table(spark, sf, "documents").select(
        F.col("doc_id").alias("file_id"), "source", F.lit("pdf").alias("kind"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("int").alias("page"), "text"
    )
    chunks = ingest.chunk_documents(documents).drop("kind", "chunk_index")
    files = documents.select(
        F.col("file_id").alias("id"),
        F.col("source").alias("external_task_key"),
        F.concat(F.lit("snapshot-"), "source").alias("snapshot_id"),
        F.concat(F.lit("doc "), F.col("file_id").cast("string")).alias("original_filename"),
        F.col("file_id").cast("string").alias("asset_id"),
    )
    versions = F.explode(F.array(F.struct(F.lit("snapshot-").alias("p"), F.lit("complete").alias("s"), F.lit(1).alias("d")), F.struct(F.lit("newer-").alias("p"), F.lit("building").alias("s"), F.lit(2).alias("d"))))
    snapshots = (
        table(spark, sf, "documents")
        .select("source")
        .distinct()
        .select("source", versions.alias("v"))
        .select(
            F.col("source").alias("external_task_key"),
            F.concat("v.p", "source").alias("id"),
            F.col("v.s").alias("ingestion_status"),
            F.timestamp_seconds(F.col("v.d")).alias("created_at"),
        )
    )
    return chunks, files, snapshots


@query(
    "chunks_in_scope",
    f"""
    select doc_id as file_id, source as external_task_key, 'doc ' || doc_id as filename, sum(greatest(1, ceil((length({sql_strip('text')}) - 150) / 850.0)))::bigint as n_chunks
    from documents where length({sql_strip('text')}) > 0 group by all
    """,
)
def chunks_in_scope(spark, sf):
    chunks, files, snapshots = _chunk_tables(spark, sf)
    scope = retrieval.chunks_in_scope(chunks, files, snapshots)
    return scope.groupBy("file_id", "external_task_key", "filename").agg(F.count(F.lit(1)).alias("n_chunks"))


@query("batch_retrieval")
def batch_retrieval(spark, sf):
    """Whole read path with the offline planner and embedder: requests to evidence."""
    chunks, files, snapshots = _chunk_tables(spark, sf)
    size = 128
    # The stored chunk table, as an ingest run leaves it.
    chunks = written(models.embed_offline(chunks, "chunk_text", "embedding", size), "chunks")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("request_id"), F.col("text").alias("question"))
    plans = models.plan_offline(asked).withColumn("queries", retrieval.sanitize_plan())
    requests = plans.select("request_id", F.concat(F.lit("src"), (F.col("request_id") % 20).cast("string")).alias("external_task_key"), "queries")
    candidates = retrieval.batch_candidates(
        requests, chunks, files, snapshots, lambda q: models.embed_offline(q, "query", "vector", size)
    )
    evidence = retrieval.diverse_evidence(candidates, extra=("section", "snippet"))
    return evidence.select("request_id", "position", "chunk_id", "filename", "section", F.round("score", 6).alias("score"))


@query("offline_embeddings")
def offline_embeddings(spark, sf):
    rows = models.embed_offline(table(spark, sf, "documents"), "text", "embedding", 256)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("doc_id", F.round(length, 4).alias("length"))
