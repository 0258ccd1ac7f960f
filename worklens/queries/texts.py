"""Queries over whole texts: chunks, statistics, display and cleaning rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from worklens import vocab
from worklens.functions import text
from worklens.operators import ingest, retrieval
from worklens.queries.base import Proxy, query, sql_collapse, sql_limited, sql_strip, table

DOCUMENTS = Proxy(
    "documents",
    {
        "file_id": "doc_id",
        "item_id": "source",
        "kind": "case when lang = 'en' then 'pdf' else 'email' end",
        "section": "case when lang = 'de' then 'email:body' else null end",
        "page": "cast(null as int)",
        "text": "text",
    },
)


@query(
    "text_chunks",
    f"""
    with d as (select *, {sql_strip('text')} as t from {DOCUMENTS.sql}),
    s as (select *, length(t) as n, greatest(1, ceil((length(t) - 150) / 850.0))::int as total from d where length(t) > 0),
    c as (select *, unnest(range(0, total)) as i from s)
    select file_id, kind, (i + 1)::int as chunk_index,
      case when section is not null and total > 1 then section || ':chunk:' || (i + 1)
           when section is not null then section
           when kind = 'pdf' then 'chunk:' || (i + 1)
           else 'offset:' || (i * 850) || '-' || least(n, i * 850 + 1000) end as section,
      length(substring(t, (i * 850 + 1)::bigint, 1000))::int as n_chars,
      md5(substring(t, (i * 850 + 1)::bigint, 1000)) as chunk_md5
    from c
    """,
)
def text_chunks(spark, sf):
    chunks = ingest.chunk_documents(DOCUMENTS.df(spark, sf))
    return chunks.select(
        "file_id", "kind", "chunk_index", "section", F.length("chunk_text").alias("n_chars"), F.md5("chunk_text").alias("chunk_md5")
    )


@query(
    "document_statistics",
    f"""
    with s as (select item_id, kind, length({sql_strip('text')}) as n from {DOCUMENTS.sql}),
    k as (select item_id, kind, count(*) as docs, sum(greatest(1, ceil((n - 150) / 850.0)))::bigint as chunks
          from s where n > 0 group by 1, 2)
    select item_id, sum(docs)::bigint as total_docs, sum(chunks)::bigint as total_chunks,
      string_agg(kind || '=' || docs, ',' order by kind) as by_kind from k group by 1
    """,
)
def document_statistics(spark, sf):
    stats = ingest.document_statistics(DOCUMENTS.df(spark, sf))
    pairs = F.transform(F.map_entries("by_kind"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return stats.select("item_id", "total_docs", "total_chunks", F.array_join(F.array_sort(pairs), ",").alias("by_kind"))


@query(
    "search_text_folding",
    f"select doc_id, length({sql_collapse('text')})::int as n_chars, md5(lower({sql_collapse('text')})) as folded_md5 from documents",
)
def search_text_folding(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.length(text.collapse("text")).alias("n_chars"), F.md5(text.fold("text")).alias("folded_md5"))


@query(
    "text_limits",
    "select doc_id, " + ", ".join(f"md5({sql_limited('text', n)}) as cut_{n}" for n in (220, 260, 500, 1800, 2000)) + " from documents",
)
def text_limits(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", *[F.md5(text.limited("text", n)).alias(f"cut_{n}") for n in (220, 260, 500, 1800, 2000)])


SNIPPETS = Proxy(
    "documents",
    {
        "doc_id": "doc_id",
        "section": "case when lang = 'en' then 'email:body' else 'chunk:1' end",
        "filename": "case when lang = 'fr' then 'Note.MSG' else 'note.pdf' end",
        "snippet": (
            "case when doc_id % 4 = 0 then concat(text, chr(10), '  Disclaimer :  ', chr(10), 'rest') "
            "when doc_id % 4 = 1 then concat(text, chr(13), chr(10), 'This e-mail and any attachments are private', chr(10), text) "
            "when doc_id % 4 = 2 then concat(text, chr(10), 'The information contained in this communication is', text) "
            "else text end"
        ),
    },
)
_D = "|".join(vocab.DISCLAIMER_PATTERNS)


@query(
    "disclaimer_cut",
    f"""
    with s as (select *, {sql_strip("replace(snippet, chr(13) || chr(10), chr(10))")} as t from {SNIPPETS.sql})
    select doc_id, case when section like 'email:%' or lower(filename) like '%.msg'
      then md5({sql_strip(f"regexp_replace(t, '(?ims)(?:{_D}).*', '')")}) else md5(t) end as snippet_md5 from s
    """,
)
def disclaimer_cut(spark, sf):
    s = SNIPPETS.df(spark, sf)
    return s.select("doc_id", F.md5(text.evidence_snippet("snippet", "section", "filename")).alias("snippet_md5"))


SECTIONS = Proxy(
    "events",
    {
        "event_id": "event_id",
        "section": (
            "case when event_id % 4 = 0 then concat('email:body:chunk:', cast(event_id as string)) "
            "when event_id % 4 = 1 then concat('chunk:', cast(event_id as string)) "
            "when event_id % 4 = 2 then concat('row:', event_type) "
            "else concat('email:attachment:a:chunk:', event_type) end"
        ),
    },
)


@query(
    "section_display",
    rf"select event_id, regexp_replace(section, '^(.*):chunk:[0-9]+$', '\1') as section from {SECTIONS.sql}",
)
def section_display(spark, sf):
    return SECTIONS.df(spark, sf).select("event_id", text.display_section("section").alias("section"))


@query(
    "filename_sanitising",
    """
    select page_id, coalesce(nullif(regexp_replace(replace(replace(url, '\\', '_'), '/', '_'), '[^A-Za-z0-9._-]+', '_', 'g'), ''), 'file') as filename
    from pages
    """,
)
def filename_sanitising(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.safe_filename("url").alias("filename"))


@query(
    "recent_history",
    f"""
    with l as (select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations),
    c as (select conv_id, turn, role, {sql_limited('text', 2000)} as content from l where rn <= 8)
    select conv_id, turn, role, md5(content) as content_md5 from c where content <> ''
    """,
)
def recent_history(spark, sf):
    h = retrieval.recent_history(table(spark, sf, "conversations"), vocab.HISTORY_LIMIT, max_chars=2000)
    return h.select("conv_id", "turn", "role", F.md5("content").alias("content_md5"))


@query(
    "running_history",
    f"""
    with c as (select conv_id, turn, role, {sql_limited('text', 2000)} as content from conversations),
    h as (
        select conv_id, turn, row_number() over (partition by conv_id order by turn, role, content) as position,
            list(case when content <> '' then turn || ':' || role || ':' || content end) over (
                partition by conv_id order by turn, role, content rows between 7 preceding and current row) as lines
        from c
    )
    select conv_id, turn, position::int as position, len(list_filter(lines, lambda x: x is not null))::int as n,
        md5(array_to_string(list_filter(lines, lambda x: x is not null), chr(10))) as history_md5
    from h
    """,
)
def running_history(spark, sf):
    """What a model would be shown at every turn of every conversation."""
    h = retrieval.running_history(table(spark, sf, "conversations"), vocab.HISTORY_LIMIT, max_chars=2000)
    lines = F.transform("history", lambda m: F.concat_ws(":", m["turn"].cast("string"), m["role"], m["content"]))
    return h.select("conv_id", "turn", "position", F.size("history").alias("n"), F.md5(F.array_join(lines, "\n")).alias("history_md5"))


BATCHED = Proxy(
    "documents",
    {
        "doc_id": "doc_id",
        "batch": "concat('intro', chr(10), '=== PDF: a.pdf ===', chr(10), text, chr(10), '=== PDF: b ', lang, '.pdf ===', chr(10), source)",
    },
)


@query(
    "batched_pdf_split",
    f"""
    select doc_id, 'a.pdf' as filename, md5({sql_strip("regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g')")}) as text_md5 from documents
    union all select doc_id, 'b ' || lang || '.pdf', md5(source) from documents
    """,
)
def batched_pdf_split(spark, sf):
    parts = BATCHED.df(spark, sf).select("doc_id", F.explode(ingest.split_batched_pdf_text("batch")).alias("p"))
    return parts.select("doc_id", "p.filename", F.md5("p.text").alias("text_md5"))


@query(
    "changed_documents_rechunked",
    f"""
    with now as (select doc_id as file_id, lang = 'en' as changed, case when lang = 'en' then text || ' ' || text else text end as t from documents),
    n as (select file_id, changed, greatest(1, ceil((length({sql_strip('t')}) - 150) / 850.0))::bigint as n, substring({sql_strip('t')}, 1, 1000) as first
        from now where length({sql_strip('t')}) > 0)
    select file_id, n as n_chunks, md5(first) as first_md5 from n
    """,
)
def changed_documents_rechunked(spark, sf):
    """The chunk table after English documents came with a longer text: their old chunks are gone, the rest stays."""
    documents = DOCUMENTS.df(spark, sf)
    stored = ingest.chunk_documents(documents).select("id", "file_id", "section", "page", "chunk_index", "chunk_text")
    longer = documents.filter("kind = 'pdf'").withColumn("text", F.concat("text", F.lit(" "), "text"))
    chunks = ingest.replace_by_file(stored, ingest.chunk_documents(longer))
    return chunks.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.md5(F.min_by("chunk_text", "chunk_index")).alias("first_md5")
    )
