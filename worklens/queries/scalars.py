"""Queries over keys, revisions, dates and values."""

from __future__ import annotations

from pyspark.sql import functions as F

from worklens import vocab
from worklens.functions import dates, keys, values, vectors, words
from worklens.functions.text import WS
from worklens.operators import routing
from worklens.queries.base import Proxy, query, sql_stamp, sql_strip, stamp, table
from worklens.sources import sinks

KEYS = Proxy(
    "orders",
    {
        "o_orderkey": "o_orderkey",
        "account": "concat('a', cast(o_custkey % 7 as string))",
        "board": "case when o_orderkey % 17 = 0 then '' else concat('b', cast(o_custkey % 3 as string)) end",
        "item": "cast(o_orderkey as string)",
        "filename": "concat(o_orderpriority, ' plan.pdf')",
    },
)
_SAFE = "regexp_replace(filename, '[^A-Za-z0-9._-]+', '_', 'g')"


@query(
    "key_builders",
    f"""
    select o_orderkey, account || ':' || board || ':' || item as task_key, board <> '' as valid,
      'monday/' || account || '/' || board || '/' || item || '/v1/derived:' || item || ':' || substring(sha256(filename), 1, 12) || ':' || {_SAFE} || '/' || {_SAFE} as object_path,
      'design-processing/' || board || '/' || item || '/' || sha256(item) || '/' || sha256('p1') || '/' || {_SAFE} as artifact_key
    from {KEYS.sql}
    """,
)
def key_builders(spark, sf):
    from worklens.functions.text import safe_filename

    k = KEYS.df(spark, sf)
    safe = safe_filename("filename")
    asset = keys.derived_asset_id("item", keys.digest("filename"), safe)
    key = keys.task_key("account", "board", "item")
    return k.select(
        "o_orderkey",
        key.alias("task_key"),
        keys.is_task_key(key).alias("valid"),
        keys.object_path(vocab.SOURCE_ROOT, "account", "board", "item", F.lit("v1"), asset, safe).alias("object_path"),
        keys.artifact_object_key("board", "item", keys.digest("item"), F.lit("p1"), safe).alias("artifact_key"),
    )


@query(
    "snapshot_versions",
    """
    with a as (select l_orderkey, string_agg(distinct l_partkey::varchar, ',' order by l_partkey::varchar) as ids from lineitem group by 1)
    select o_orderkey, sha256(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ':' || coalesce(ids, '')) as snapshot_version
    from orders left join a on l_orderkey = o_orderkey
    """,
)
def snapshot_versions(spark, sf):
    # Distinct ids are collected, so a repeated asset is dropped before the shuffle.
    ids = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_set(F.col("l_partkey").cast("string")).alias("ids")
    )
    o = table(spark, sf, "orders").select("o_orderkey", stamp("o_orderdate").alias("updated_at"))
    version = keys.snapshot_version("updated_at", keys.distinct_ids(F.col("ids")))
    return o.join(ids, "o_orderkey", "left").select("o_orderkey", version.alias("snapshot_version"))


@query(
    "input_revisions",
    f"""
    select l_orderkey, sha256('[' || string_agg('{{"assetId":"' || l_linenumber || '","createdAt":"' || strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ')
      || '","filename":"é ' || l_partkey || '.eml","size":' || l_quantity::int || '}}', ',' order by l_linenumber, l_partkey || '', strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ'), l_quantity) || ']') as input_revision
    from lineitem group by 1
    """,
)
def input_revisions(spark, sf):
    record = F.struct(
        F.col("l_linenumber").cast("string").alias("asset_id"),
        dates.iso_utc(F.col("l_shipdate").cast("timestamp")).alias("created_at"),
        F.concat(F.lit("é "), F.col("l_partkey").cast("string"), F.lit(".eml")).alias("filename"),
        F.col("l_quantity").cast("long").alias("size"),
    )
    # The records of one item document; the revision is defined over all of them.
    assets = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(record).alias("assets"))
    return assets.select("l_orderkey", keys.input_revision("assets").alias("input_revision"))


@query(
    "processing_versions",
    """
    select c_custkey, 'legacy-files-' || c_name || ':model-' || c_mktsegment || ':thinking-low:r1' as version,
      sha256('legacy-files-' || c_name || ':model-' || c_mktsegment || ':thinking-low:r1') as version_digest from customer
    """,
)
def processing_versions(spark, sf):
    version = keys.processing_version("c_name", "c_mktsegment", F.lit("low"), F.lit("r1"))
    return table(spark, sf, "customer").select("c_custkey", version.alias("version"), keys.digest(version).alias("version_digest"))


@query(
    "artifact_names",
    """
    with l as (select *, o_orderkey || '_' || substring(sha256(o_orderkey::varchar), 1, 12) || '_' || substring(sha256(o_orderpriority), 1, 12) as label from orders),
    n as (select *, unnest(['ai_data', 'ai_data_pdf', 'match_report']) as artifact_kind from l),
    f as (select *, case artifact_kind when 'ai_data' then 'AI_Data_' || label || '.csv' when 'ai_data_pdf' then 'AI_Data_Preview_' || label || '.pdf'
      else 'Matched_Projects_' || label || '.pdf' end as filename from n)
    select o_orderkey::varchar as item_id, artifact_kind, filename,
      'design-processing/b' || o_custkey || '/' || o_orderkey || '/' || sha256(o_orderkey::varchar) || '/' || sha256(o_orderpriority) || '/' || filename as object_key from f
    """,
)
def artifact_names(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("item_id"),
        F.concat(F.lit("b"), F.col("o_custkey").cast("string")).alias("board_id"),
        keys.digest("o_orderkey").alias("input_revision"),
        F.col("o_orderpriority").alias("pipeline_version"),
    )
    return sinks.artifact_manifest(o).select("item_id", "artifact_kind", "filename", "object_key")


ZONED = Proxy(
    "events",
    {
        "event_id": "event_id",
        "kind": "event_id % 5",
        "ts": "cast(ts as timestamp)",
    },
)


@query(
    "utc_timestamps",
    """
    select event_id, case event_id % 5 when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%SZ') when 1 then strftime(ts - interval 90 minutes, '%Y-%m-%dT%H:%M:%SZ')
      when 2 then strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when epoch_us(ts) % 1000000 = 0 then '' else strftime(ts, '.%f') end || 'Z' end as utc from events
    """,
)
def utc_timestamps(spark, sf):
    e = ZONED.df(spark, sf)
    seconds = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = (
        F.when(F.col("kind") == 0, F.concat(F.lit(" "), seconds, F.lit("z ")))
        .when(F.col("kind") == 1, F.concat(seconds, F.lit("+01:30")))
        .when(F.col("kind") == 2, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+0000")))
        .when(F.col("kind") == 3, seconds)
        .otherwise("not a date")
    )
    return e.select("event_id", dates.normalize_utc(raw).alias("utc"))


# Order dates moved to 2020-2026 with a time of day, so that both clock changes occur.
MAIL_TIMES = Proxy(
    "orders",
    {"o_orderkey": "o_orderkey", "t": "cast(o_orderdate as timestamp) + interval '25' year + interval '37' minute"},
)
_LAST_SUNDAY = "(date_trunc('year', t) + interval '{m} months' + interval '30 days' - to_days(extract(dow from date_trunc('year', t) + interval '{m} months' + interval '30 days')::int) + interval 1 hour)"


@query(
    "mail_dates_in_london",
    f"""
    with z as (select *, t >= {_LAST_SUNDAY.format(m=2)} and t < {_LAST_SUNDAY.format(m=9)} as summer from {MAIL_TIMES.sql})
    select o_orderkey, case when o_orderkey % 6 = 5 then 'unknown' else strftime(t + case when summer then interval 1 hour else interval 0 hour end, '%a, %d %b %Y %H:%M:%S ')
      || case when summer then '+0100' else '+0000' end end as shown from z
    """,
)
def mail_dates_in_london(spark, sf):
    m = MAIL_TIMES.df(spark, sf)
    kind = F.col("o_orderkey") % 6
    shifted = F.col("t") + F.expr("interval '5' hour")
    raw = (
        F.when(kind == 0, F.concat(F.date_format("t", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000")))
        .when(kind == 1, F.concat(F.date_format("t", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(kind == 2, F.concat(F.date_format(shifted, "d MMM yyyy HH:mm:ss"), F.lit(" +0500 (PKT)")))
        .when(kind == 3, F.date_format("t", "EEE, d MMM yyyy HH:mm"))
        .when(kind == 4, F.concat(F.date_format(shifted, "d MMM yyyy HH:mm"), F.lit(" +0500")))
        .otherwise("unknown")
    )
    return m.select("o_orderkey", dates.mail_date_in_london(raw).alias("shown"))


LAYOUTS = Proxy("orders", {"o_orderkey": "o_orderkey", "t": "cast(o_orderdate as timestamp)", "kind": "o_orderkey % 13"})


@query(
    "flexible_dates",
    f"select o_orderkey, case when kind < 10 then strftime(t, '%Y-%m-%d') else '' end as iso_date from {LAYOUTS.sql}",
)
def flexible_dates(spark, sf):
    d = LAYOUTS.df(spark, sf)
    masks = ["dd/MM/yyyy", "d-M-yyyy", "yyyy-MM-dd", "yyyy/M/d", "d MMM yyyy", "dd MMMM yyyy", "MMMM d, yyyy", "MMM dd, yyyy", "d/M/yy", "dd-MM-yy"]
    raw = F.when(F.col("kind") == 10, F.lit("31/02/2026")).when(F.col("kind") == 11, F.lit("Not found"))
    for i, mask in enumerate(masks):
        raw = raw.when(F.col("kind") == i, F.concat(F.lit(': "' if i == 0 else " "), F.date_format("t", mask), F.lit('"' if i == 0 else " ")))
    return d.select("o_orderkey", dates.flexible_date(raw).alias("iso_date"))


HOURS = Proxy("events", {"event_id": "event_id", "t": "cast(ts as timestamp)", "kind": "event_id % 5"})


@query(
    "hour_values",
    f"""
    select event_id, case when kind = 4 then null when kind = 3 then 30 else extract(hour from t) end::int as hour,
      case when kind = 4 then null when kind = 3 then 99 else extract(minute from t) end::int as minute from {HOURS.sql}
    """,
)
def hour_values(spark, sf):
    h = HOURS.df(spark, sf)
    raw = (
        F.when(F.col("kind") == 0, F.date_format("t", "H:mm"))
        .when(F.col("kind") == 1, F.date_format("t", "HH.mm"))
        .when(F.col("kind") == 2, F.upper(F.date_format("t", "h:mm a")))
        .when(F.col("kind") == 3, F.lit("30:99"))
        .otherwise("12:5")
    )
    clock = dates.hour_minute(raw)
    return h.select("event_id", clock["hour"].alias("hour"), clock["minute"].alias("minute"))


RAW_VALUES = Proxy(
    "customer",
    {
        "c_custkey": "c_custkey",
        "raw": (
            "case c_custkey % 6 when 0 then concat(' : ', c_name) when 1 then concat('\"Name\": \"', c_name, ' \"') when 2 then concat('\"', c_name, '\",') "
            "when 3 then '' when 4 then concat('x : ''', c_mktsegment, '''') else c_name end"
        ),
    },
)


@query(
    "value_cleaning",
    "select c_custkey, case c_custkey % 6 when 3 then '' when 4 then c_mktsegment else c_name end as value from customer",
)
def value_cleaning(spark, sf):
    return RAW_VALUES.df(spark, sf).select("c_custkey", values.clean_value("raw").alias("value"))


@query(
    "missing_values",
    """
    select c_custkey, c_custkey % 6 in (0, 1, 2, 3) as missing from customer
    """,
)
def missing_values(spark, sf):
    c = table(spark, sf, "customer")
    options = F.array(*[F.lit(v) for v in (" Not Found ", "n/a", "", "NOT available", "Not provided")], F.col("c_name"))
    return c.select("c_custkey", values.is_missing(F.get(options, (F.col("c_custkey") % 6).cast("int"))).alias("missing"))


LABELS = '{"labels": [{"id": 1, "name": "BUILDING"}, {"id": 2, "name": "MACHINERY"}, {"id": 3, "name": "BUILDING"}]}'


@query(
    "label_lookup",
    "select c_custkey, case c_mktsegment when 'BUILDING' then 1 when 'MACHINERY' then 2 end::bigint as label_id from customer",
)
def label_lookup(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", values.label_id("c_mktsegment", F.lit(LABELS)).alias("label_id"))


POSTCODES = Proxy(
    "customer",
    {
        "c_custkey": "c_custkey",
        "raw": (
            "case c_custkey % 6 when 0 then concat('of Project Location:* sw', cast(c_nationkey as string), ' 4LX') when 1 then 'wa4 6nl' "
            "when 2 then 'postcode not  provided' when 3 then 'None given' when 4 then c_mktsegment else concat(' M', cast(c_nationkey as string)) end"
        ),
    },
)


@query(
    "postcode_areas",
    "select c_custkey, case c_custkey % 6 when 0 then 'SW' when 1 then 'WA' when 2 then 'Not provided' when 3 then 'Not provided' when 4 then c_mktsegment else 'M' end as area from customer",
)
def postcode_areas(spark, sf):
    return POSTCODES.df(spark, sf).select("c_custkey", values.postcode_area("raw").alias("area"))


PRODUCTS = Proxy(
    "part",
    {
        "p_partkey": "p_partkey",
        "raw": (
            "case p_partkey % 8 when 0 then concat('Bauder tr27 ', p_brand) when 1 then 'FOIL' when 2 then p_name when 3 then 'Rock Wool slab' "
            "when 4 then 'Not found' when 5 then 'Expanded Polystrene board' when 6 then '' else 'TR/BGM' end"
        ),
    },
)


def _sql_category(v: str) -> str:
    whens = " ".join(
        f"when contains(lower({v}), '{p.lower()}') or contains('{p.lower()}', lower({v})) then '{category}'"
        for category, products in vocab.INSULATION_CATEGORIES
        for p in products
    )
    return f"case when {v} in ('', 'Not found') then {v} {whens} else {v} end"


@query("insulation_categories", f"select p_partkey, {_sql_category('raw')} as category from {PRODUCTS.sql}")
def insulation_categories(spark, sf):
    return PRODUCTS.df(spark, sf).select("p_partkey", values.insulation_category("raw").alias("category"))


@query(
    "header_dates",
    """
    select event_id, case when event_id % 4 < 2 then ltrim(strftime(ts, '%d %b %Y'), '') end as date_received,
      case when event_id % 4 = 0 then strftime(ts, '%H:%M') end as hour_received from events
    """,
)
def header_dates(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    kind = F.col("event_id") % 4
    shown = (
        F.when(kind == 0, F.date_format("t", "EEE, dd MMM yyyy HH:mm:ss"))
        .when(kind == 1, F.date_format("t", "dd MMM yyyy"))
        .when(kind == 2, F.date_format("t", "HH:mm"))
        .otherwise("")
    )
    text = F.concat(F.lit("x\nEMAIL CONTENT:\nFrom: a\nTo: b\nc\nSubject: s\nDate: "), shown, F.lit("\n\nbody"))
    text = F.when(kind == 3, F.lit("no mail")).otherwise(text)
    h = dates.header_date(text)
    return e.select("event_id", h["date_received"].alias("date_received"), h["hour_received"].alias("hour_received"))


@query(
    "vector_normalisation",
    """
    with e as (select vec_id, embedding::double[] as v from embeddings), n as (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from e)
    select vec_id, unnest(range(1, 65))::int as dimension, round(unnest(v) / n, 6) as component from n
    """,
)
def vector_normalisation(spark, sf):
    e = table(spark, sf, "embeddings")
    rows = e.select("vec_id", F.posexplode(vectors.l2_normalize("embedding")).alias("i", "x"))
    return rows.select("vec_id", (F.col("i") + 1).alias("dimension"), F.round("x", 6).alias("component"))


@query(
    "retry_delays",
    """
    select l_orderkey, l_linenumber, l_partkey, least(3600, 60 * pow(2, least(greatest(l_suppkey - 1, 0), 62)))::bigint as retry_seconds,
      least(3600, 30 * pow(2, least(l_suppkey, 62)))::bigint as readiness_seconds from lineitem
    """,
)
def retry_delays(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        values.retry_delay_seconds("l_suppkey").alias("retry_seconds"),
        values.readiness_delay_seconds("l_suppkey").alias("readiness_seconds"),
    )


@query(
    "percentage_texts",
    "select p_partkey, printf('%.1f%%', p_partkey::double / (p_partkey + p_retailprice) * 100) as share from part",
)
def percentage_texts(spark, sf):
    share = F.col("p_partkey").cast("double") / (F.col("p_partkey") + F.col("p_retailprice"))
    return table(spark, sf, "part").select("p_partkey", values.percent_text(share).alias("share"))


@query(
    "byte_sizes",
    """
    with s as (select o_orderkey, case when o_orderkey % 50 = 0 then 0 when o_orderkey % 50 = 1 then null
        else floor(o_totalprice * pow(7, o_orderkey % 8)) end as b from orders),
    u as (select *, floor(ln(b) / ln(1024))::int as u from s where b > 0)
    select o_orderkey, case when b / pow(1024, u) >= 10 then printf('%.1f', floor(b / pow(1024, u) * 10 + 0.5) / 10) else printf('%.2f', floor(b / pow(1024, u) * 100 + 0.5) / 100) end
      || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][u + 1] as size_text from u
    union all select o_orderkey, case when b is null then '—' else '0 B' end from s where b is null or b = 0
    """,
)
def byte_sizes(spark, sf):
    """Ties round up, as the display does; ``printf`` alone would round them to even."""
    o = table(spark, sf, "orders")
    size = (
        F.when(F.col("o_orderkey") % 50 == 0, 0.0)
        .when(F.col("o_orderkey") % 50 == 1, F.lit(None))
        .otherwise(F.floor(F.col("o_totalprice") * F.pow(F.lit(7.0), F.col("o_orderkey") % 8)))
    )
    return o.select("o_orderkey", values.byte_size_text(size).alias("size_text"))


FILES = Proxy(
    "lineitem",
    {
        "l_orderkey": "l_orderkey",
        "l_linenumber": "l_linenumber",
        "l_partkey": "l_partkey",
        "filename": (
            "case l_partkey % 12 when 0 then 'Drawing.PDF' when 1 then 'mail.eml' when 2 then 'ai_data_preview_1.pdf' when 3 then 'photo.JPEG' when 4 then 'scan.gif' "
            "when 5 then 'table.csv' when 6 then 'notes.docx' when 7 then 'old.msg' when 8 then concat('TP-', cast(10000 + l_suppkey as string), ' roof.webp') "
            "when 9 then '.eml' when 10 then 'noext' else 'x.bmp' end"
        ),
        "extension": "case when l_partkey % 12 = 10 and l_suppkey % 2 = 0 then 'EML' when l_partkey % 12 = 10 then '.CSV' when l_suppkey % 5 = 0 then '.pdf' else '' end",
        "kind": "case when l_linenumber % 3 = 0 then 'csv' when l_linenumber % 5 = 1 then 'email' else 'attachment' end",
        "mime": "case when l_suppkey % 9 = 0 then 'image/png' else 'application/octet-stream' end",
        "file_size": (
            "case l_suppkey % 6 when 0 then 'unknown' when 1 then '-5' when 2 then cast(null as string) else cast(cast(l_quantity as int) * 1500000 as string) end"
        ),
    },
)
_SIZE = "case when try_cast(file_size as bigint) >= 0 then try_cast(file_size as bigint) end"
_N = "lower(filename)"
_PREVIEW = f"(kind = 'csv' and {_N} like 'ai\\_data\\_preview\\_%' escape '\\' and (ltrim(lower(extension), '.') = 'pdf' or {_N} like '%.pdf'))"
_CSV = f"(kind = 'csv' or lower(extension) = '.csv' or {_N} like '%.csv')"


@query(
    "file_type_predicates",
    f"""
    select l_orderkey, l_linenumber, l_partkey,
      case when {_N} like '%.pdf' then 'attachment_pdf' when regexp_matches({_N}, '\\.(jpe?g|png|gif|bmp|webp)$') then 'attachment_image' else 'attachment_other' end as attachment_kind,
      {_CSV} as is_csv, {_PREVIEW} as is_preview,
      regexp_matches({_N}, '[^/]\\.(eml|msg)$') or lower(extension) in ('.eml', '.msg', 'eml', 'msg') as is_email,
      kind = 'attachment_image' or mime like 'image/%' or regexp_matches({_N}, '\\.(png|jpe?g|gif|bmp|webp)$') as is_image
    from {FILES.sql}
    """,
)
def file_type_predicates(spark, sf):
    f = FILES.df(spark, sf)
    return f.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        routing.attachment_kind("filename").alias("attachment_kind"),
        routing.is_csv("filename", "extension", "kind").alias("is_csv"),
        routing.is_preview_pdf("filename", "extension", "kind").alias("is_preview"),
        routing.is_supported_email("filename", "extension").alias("is_email"),
        routing.is_image("kind", "mime", "filename").alias("is_image"),
    )


@query(
    "storage_size_gate",
    f"""
    with s as (select *, {_SIZE} as b from {FILES.sql})
    select l_orderkey, l_linenumber, l_partkey, b as size_bytes, case when b > 50000000 then 'unsupported' else 'stored' end as storage_status,
      case when b > 50000000 then 'object_too_large' end as storage_error_code,
      case when b > 50000000 then 'Monday reported asset size ' || b || ' bytes exceeds the configured storage limit of 50000000 bytes' end as storage_error_detail from s
    """,
)
def storage_size_gate(spark, sf):
    gated = routing.storage_gate(FILES.df(spark, sf), vocab.MAX_OBJECT_BYTES)
    return gated.select("l_orderkey", "l_linenumber", "l_partkey", "size_bytes", "storage_status", "storage_error_code", "storage_error_detail")


@query(
    "asset_routes",
    f"""
    with s as (select *, {_SIZE} as b from {FILES.sql}),
    r as (select case when b > 50000000 then 'oversize' when {_PREVIEW} then 'preview' when {_CSV} then 'csv'
      when {_N} like '%.eml' or {_N} like '%.msg' or kind = 'email' then 'email' when {_N} like '%.pdf' then 'pdf'
      when regexp_matches({_N}, '\\.(jpe?g|png|webp)$') then 'image' when regexp_matches({_N}, '\\.(gif|bmp)$') then 'image_placeholder' else 'store_only' end as route from s)
    select route, count(*) as n from r group by 1
    """,
)
def asset_routes(spark, sf):
    f = FILES.df(spark, sf)
    routed = f.select(routing.route("filename", "extension", "kind", "file_size", vocab.MAX_OBJECT_BYTES).alias("route"))
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query(
    "placeholder_texts",
    f"""
    select l_orderkey, l_linenumber, l_partkey, case when {_N} like '%.pdf' and q > 31457280 then 'PDF too large for extraction (' || q || ' bytes).'
      when regexp_matches({_N}, '\\.(jpe?g|png|webp)$') and q > 10485760 then 'Image too large for extraction (' || q || ' bytes).'
      when regexp_matches({_N}, '\\.(gif|bmp)$') then 'Unsupported image format: ' || regexp_extract({_N}, '([^.]*)$', 1) end as placeholder
    from (select *, length(filename) * 3000000::bigint as q from {FILES.sql})
    """,
)
def placeholder_texts(spark, sf):
    f = FILES.df(spark, sf).withColumn("q", F.length("filename") * F.lit(3_000_000).cast("long"))
    r = routing.route("filename", F.lit(""), F.lit("attachment"), F.lit("1"))
    text = routing.placeholder_text(r, "filename", "q", vocab.MAX_PDF_BYTES, vocab.MAX_IMAGE_BYTES)
    return f.select("l_orderkey", "l_linenumber", "l_partkey", text.alias("placeholder"))


@query(
    "pdf_batches",
    f"""
    select l_orderkey, count(*) as n_pdfs, sum(coalesce({_SIZE}, 0))::bigint as total_bytes,
      sum(coalesce({_SIZE}, 0)) <= 104857600 and count(*) between 2 and 3 as batchable
    from {FILES.sql} where {_N} like '%.pdf' group by 1
    """,
)
def pdf_batches(spark, sf):
    f = FILES.df(spark, sf).withColumn("size_bytes", F.coalesce(values.lenient_size("file_size"), F.lit(0)))
    return routing.pdf_batches(f, "l_orderkey")


@query(
    "project_numbers",
    f"""
    select l_orderkey, arg_min(regexp_extract(filename, '(?i)TP[\\s_-]*([0-9]{{4,}})', 1), (l_linenumber, l_partkey, filename)) as project_number
    from {FILES.sql} where regexp_matches(filename, '(?i)\\bTP[\\s_-]*[0-9]{{4,}}') group by 1
    """,
)
def project_numbers(spark, sf):
    f = FILES.df(spark, sf).withColumn("number", values.project_number("filename")).filter("number is not null")
    return f.groupBy("l_orderkey").agg(F.min_by("number", F.struct("l_linenumber", "l_partkey", "filename")).alias("project_number"))


NAMES = Proxy(
    "part",
    {
        "p_partkey": "p_partkey",
        "name": "concat('The ', p_name, ' of St. ', p_type, ' Rd.', cast(p_size as string), 'B ', p_brand, ' SW6 4LX GIR ', p_name, '''s A12')",
    },
)


@query(
    "meaningful_words",
    rf"""
    with t as (select p_partkey, regexp_extract_all(regexp_replace(name, '\b(St|Dr|Rd)\.\s*', '\1 ', 'g'), '\b\w+(?:''\w+)*\b') as w from {NAMES.sql})
    select p_partkey, list_aggregate(list_filter(w, lambda x: not regexp_full_match(upper(x), '\d+[A-Z]?|GIR|[A-Z][0-9]{{1,2}}|[A-Z][A-HJKPSTUW][0-9]{{1,2}}|[A-Z][0-9][A-Z]|[A-Z][A-HJKPSTUW][0-9][A-Z]|[0-9][A-Z]{{2}}|0[A-Z]{{2}}|[A-Z]+\d+')
      and lower(x) not in ({", ".join(f"'{w}'" for w in vocab.STOP_WORDS)}) and (length(x) > 2 or upper(x) in ('OF', 'ST', 'DR', 'RD'))), 'string_agg', '|') as words from t
    """,
)
def meaningful_words(spark, sf):
    return NAMES.df(spark, sf).select("p_partkey", F.array_join(words.meaningful_words("name"), "|").alias("words"))
