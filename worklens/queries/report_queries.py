"""Queries over extracted parameters, mail texts and report rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from worklens import vocab
from worklens.operators import extraction, ingest, models
from worklens.queries.base import Proxy, query, table

ANSWERS = Proxy(
    "customer",
    {
        "item_id": "c_custkey",
        "all_text": (
            "case when c_custkey % 3 = 0 then concat('EMAIL CONTENT:', chr(10), 'From: a', chr(10), 'To: b', chr(10), 'Subject: s', chr(10), 'Date: Fri, 30 Jan 2026 15:45:00 +0000', chr(10), 'x') else 'no mail' end"
        ),
        "subject": "concat(' ', c_name, ' ')",
        "postcode": "case when c_custkey % 2 = 0 then 'WA4 6NL' else '  ' end",
        "insulation": "case c_custkey % 3 when 0 then 'TR27' when 1 then 'Foil' else 'Own product 1' end",
        "received": "case when c_custkey % 5 = 0 then cast(null as string) else '1 Feb 2026' end",
        "company": "concat(': \"', c_mktsegment, '\"')",
    },
)
_FIELDS = {"Email Subject": "subject", "Post Code": "postcode", "Tapered Insulation": "insulation", "Date Received": "received", "Company": "company"}


def _answers(spark, sf):
    rows = ANSWERS.df(spark, sf)
    fields = F.create_map(*[x for name, c in _FIELDS.items() for x in (F.lit(name), F.col(c))])
    return rows.select("item_id", "all_text", fields.alias("fields"))


_VALUE = {
    "Email Subject": "trim(subject)",
    "Post Code": "case when postcode = 'WA4 6NL' then 'WA' else 'Not provided' end",
    "Tapered Insulation": "case insulation when 'TR27' then 'TissueFaced PIR' when 'Foil' then 'FoilFaced PIR' else insulation end",
    "Date Received": "case when item_id % 3 = 0 then '30 Jan 2026' else coalesce(received, 'Not provided') end",
    "Hour Received": "case when item_id % 3 = 0 then '15:45' else 'Not provided' end",
    "Company": "company",
}
_LONG = " union all ".join(
    f"select item_id, '{p}' as parameter, {_VALUE.get(p, repr('Not provided'))} as value, 'Email Content' as source from {ANSWERS.sql}"
    if p != "Reason for Change"
    else f"select item_id, '{p}', '{vocab.REASON_FOR_CHANGE}', 'Business Rule' from {ANSWERS.sql}"
    for p in vocab.CANONICAL_PARAMETERS
)


@query("canonical_parameters", _LONG)
def canonical_parameters(spark, sf):
    return extraction.canonical_parameters(_answers(spark, sf))


@query(
    "parameter_report",
    f"""
    with p as ({_LONG} union all select c_custkey, 'Extra ' || c_mktsegment, c_name, null from customer)
    select item_id, coalesce(list_position([{", ".join(f"'{p}'" for p in vocab.CANONICAL_PARAMETERS)}], parameter), 999)::int as seq, parameter,
      case when parameter = 'Company' then trim(value, ': "') else value end as value, coalesce(source, '') as source from p
    """,
)
def parameter_report(spark, sf):
    extra = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("item_id"),
        F.concat(F.lit("Extra "), "c_mktsegment").alias("parameter"),
        F.col("c_name").alias("value"),
        F.lit(None).cast("string").alias("source"),
    )
    rows = extraction.canonical_parameters(_answers(spark, sf)).unionByName(extra)
    return extraction.report_rows(rows)


PARTS = Proxy(
    "lineitem",
    {
        "item_id": "l_orderkey",
        "asset_id": "cast(l_linenumber as string)",
        "filename": "concat('mail', cast(l_linenumber as string), '.eml')",
        "header": "concat('h', cast(l_linenumber as string))",
        "body": "'b'",
        "part_kind": "case l_partkey % 5 when 0 then 'inline' else 'attachment' end",
        "attachment": "case l_partkey % 5 when 0 then 'logo.png' when 1 then 'Plan.PDF' when 2 then 'photo.JPG' when 3 then 'list.docx' else 'pic.webp' end",
        "size_bytes": "cast(l_quantity as bigint)",
        "part_index": "cast(round(l_extendedprice * 100) as bigint)",
        "text": "l_returnflag",
    },
)
_PIECE = """case part_kind when 'inline' then chr(10) || 'INLINE IMAGE (logo.png):' || chr(10) || text || chr(10) || chr(10)
    else case attachment when 'Plan.PDF' then chr(10) || 'PDF ATTACHMENT (Plan.PDF):' || chr(10) || text || chr(10) || chr(10)
      when 'photo.JPG' then chr(10) || 'IMAGE ATTACHMENT (photo.JPG):' || chr(10) || text || chr(10) || chr(10)
      else chr(10) || 'ATTACHMENT (' || attachment || ') [Not processed - not a PDF or image]' || chr(10) || chr(10) end end"""
_RANK = "case when part_kind = 'inline' then 4 when attachment = 'Plan.PDF' then 2 when attachment = 'photo.JPG' then 3 else 1 end"


@query(
    "mail_texts",
    f"""
    with m as (select item_id, asset_id, filename, 'EMAIL CONTENT:' || chr(10) || any_value(header) || chr(10) || 'b' || chr(10) || chr(10)
        || string_agg({_PIECE}, '' order by {_RANK}, case when attachment = 'Plan.PDF' then size_bytes else 0 end, part_index, {_PIECE}) as t from {PARTS.sql} group by 1, 2, 3)
    select item_id, sha256(string_agg(chr(10) || chr(10) || 'EMAIL FILE: ' || filename || chr(10) || t || chr(10) || repeat('=', 50) || chr(10), '' order by asset_id::int)) as text_sha256 from m group by 1
    """,
)
def mail_texts(spark, sf):
    parts = PARTS.df(spark, sf)
    heads = parts.select("item_id", "asset_id", "filename", "header", "body").distinct()
    mails = heads.select(
        "*",
        F.lit("mail").alias("part_kind"),
        F.lit(None).cast("string").alias("attachment"),
        F.lit(0).cast("long").alias("size_bytes"),
        F.lit(-1).cast("long").alias("part_index"),
        F.lit(None).cast("string").alias("text"),
    )
    return ingest.item_texts(ingest.mail_texts(parts.unionByName(mails))).select("item_id", "text_sha256")


@query(
    "mail_pieces",
    f"""
    select item_id, asset_id, {_RANK} as rank, case when attachment = 'Plan.PDF' then size_bytes else 0 end as size, part_index as part, {_PIECE} as piece
    from {PARTS.sql}
    """,
)
def mail_pieces(spark, sf):
    rows = ingest.mail_pieces(PARTS.df(spark, sf))
    return rows.select("item_id", "asset_id", "place.rank", "place.size", "place.part", "piece")


LINES_TEXT = Proxy(
    "documents",
    {
        "item_id": "doc_id",
        "all_text": "concat(text, chr(10), 'company : ', source, '  ', chr(10), 'Post Code: WA', cast(doc_id as string), chr(10), 'Company: later', chr(10), 'Scale:', chr(10))",
    },
)


@query(
    "offline_field_extraction",
    "select doc_id as item_id, source as company, 'WA' || doc_id as post_code, null::varchar as scale from documents",
)
def offline_field_extraction(spark, sf):
    found = models.extract_fields_offline(LINES_TEXT.df(spark, sf))
    return found.select(
        "item_id", F.col("fields")["Company"].alias("company"), F.col("fields")["Post Code"].alias("post_code"), F.col("fields")["Scale"].alias("scale")
    )
