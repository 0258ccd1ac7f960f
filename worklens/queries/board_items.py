"""Queries over item documents built from the given tables, and over file rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from worklens import schemas, vocab
from worklens.operators import ingest, quality
from worklens.queries import plan_tables as t
from worklens.queries.base import Proxy, query, table
from worklens.scale import number_rows, top_k
from worklens.sources import items as item_source

LINES = Proxy(
    "lineitem",
    {
        "item_id": "cast(l_orderkey as string)",
        "pos": "l_linenumber",
        "line": "l_partkey",
        "price": "cast(round(l_extendedprice * 100) as bigint)",
        "asset_id": "cast(l_partkey % 6 as string)",
        "col": "l_suppkey % 4",
        "own": "l_returnflag = 'A'",
        "filename": "case when l_partkey % 3 < 2 then concat('m', cast(l_partkey as string), '.eml') else 'd.pdf' end",
        "flaw": "l_suppkey % 20",
    },
)
_ORDER = "pos, line, price"


def _asset(id_column: str):
    text = F.lit(None).cast("string")
    values = {"id": F.col(id_column), "name": F.col("filename"), "file_extension": text, "file_size": text, "url": text, "public_url": text, "created_at": text}
    return F.struct(*[values[f].cast("string").alias(f) for f in schemas.ASSET.fieldNames()])


def _items(spark, sf):
    """Item documents: the lines of an order are its assets."""
    place = [F.col(c) for c in ("pos", "line", "price")]
    rows = LINES.df(spark, sf)

    def assets(where):
        picked = F.collect_list(F.when(where, F.struct(*place, _asset("asset_id").alias("a"))))
        return F.transform(F.array_sort(picked), lambda x: x["a"])

    def column(i, title):
        # A later column with the same asset decides; broken JSON is skipped.
        files = F.collect_list(F.when(F.col("col") == i, F.struct(F.col("asset_id").alias("assetId"), F.col("filename").alias("name"))))
        return F.struct(F.lit(title).alias("title"), F.to_json(F.struct(files.alias("files"))).alias("value"))

    grouped = rows.groupBy("item_id").agg(
        assets(F.col("own")).alias("assets"),
        assets(~F.col("own")).alias("later"),
        F.array(column(0, " Email "), column(1, "AI Data"), column(2, "Site Photos (new)"), column(3, "--")).alias("cols"),
    )
    shaped = F.transform(
        F.array_append(F.col("cols"), F.struct(F.lit("Bad").alias("title"), F.lit("{oops").alias("value"))),
        lambda c: F.struct(F.struct(c["title"].alias("title")).alias("column"), F.lit("file").alias("type"), c["value"].alias("value")),
    )
    updates = F.array(F.struct(F.lit("u1").alias("id"), F.col("later").alias("assets")))
    return grouped.select("item_id", "assets", updates.alias("updates"), shaped.alias("column_values"))


_KINDS = f"""select item_id, asset_id, ['email', 'csv', 'site_photos_new', 'attachment'][max(col)::int + 1] as kind from {LINES.sql} group by 1, 2"""


@query("asset_kinds", _KINDS)
def asset_kinds(spark, sf):
    return item_source.asset_kinds(_items(spark, sf))


@query(
    "prioritised_assets",
    f"""
    with r as (select *, row_number() over (partition by item_id, asset_id order by not own, {_ORDER}) as rn from {LINES.sql}), k as ({_KINDS})
    select r.item_id, r.asset_id, case when own then k.kind else 'update_attachment' end as kind, r.filename from r join k using (item_id, asset_id) where rn = 1
    """,
)
def prioritised_assets(spark, sf):
    return item_source.asset_jobs(_items(spark, sf)).select("item_id", "asset_id", "kind", F.col("asset.name").alias("filename"))


COLUMNS = Proxy(
    "orders",
    {
        "o_orderkey": "o_orderkey",
        "priority": "case when o_custkey % 3 = 0 then '' else o_orderpriority end",
        "status": "o_orderstatus",
        "zip": f"case when o_custkey % 2 = 0 then {t.NULL_TEXT} else cast(o_custkey as string) end",
    },
)


@query(
    "column_texts",
    f"""
    select o_orderkey, concat_ws(chr(10), case when priority <> '' then 'Column: Priority | Value: ' || priority else 'Column: Priority | Value: raw' end,
      'Column: Status | Value: ' || status, case when zip is not null then 'Column: Zip Code | Value: ' || zip end) as column_text from {COLUMNS.sql}
    """,
)
def column_texts(spark, sf):
    def column(title, display, text, value):
        return F.struct(
            F.struct(F.lit(title).cast("string").alias("title")).alias("column"),
            F.lit(value).cast("string").alias("value"),
            text.cast("string").alias("text"),
            display.cast("string").alias("display_value"),
        )

    none = F.lit(None)
    columns = F.array(
        column("Priority", F.lit(""), F.col("priority"), "raw"),
        column("Owner", F.col("status"), none, None),
        column("Status", F.col("status"), F.lit("x"), "y"),
        column(None, F.col("status"), none, None),
        column("Zip Code", none, F.col("zip"), None),
    )
    rows = COLUMNS.df(spark, sf)
    return rows.select("o_orderkey", item_source.column_text(columns).alias("column_text"))


@query(
    "project_labels",
    f"""
    with f as (select l_orderkey, arg_min(10000 + l_suppkey, (l_linenumber, l_partkey, l_suppkey)) as n from lineitem where l_partkey % 12 = 8 group by 1)
    select o_orderkey::varchar as item_id, case when o_custkey % 3 = 0 then o_orderpriority else coalesce(f.n::varchar, '') end as project from orders left join f on l_orderkey = o_orderkey
    """,
)
def project_labels(spark, sf):
    empty = F.lit(None).cast("string")
    columns = F.array(
        F.struct(F.struct(F.lit("Project No ").alias("title")).alias("column"), F.lit(" ").alias("value"), empty.alias("text"), empty.alias("display_value")),
        F.struct(
            F.struct(F.lit("PROJECT").alias("title")).alias("column"),
            F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderpriority")).alias("value"),
            F.lit("").alias("text"),
            empty.alias("display_value"),
        ),
    )
    items = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("item_id"), columns.alias("column_values"))
    lines = table(spark, sf, "lineitem")
    name = F.when(F.col("l_partkey") % 12 == 8, F.concat(F.lit("tp_ "), (F.col("l_suppkey") + 10000).cast("string"), F.lit("a.pdf"))).otherwise("TP 12.pdf")
    files = lines.select(
        F.col("l_orderkey").cast("string").alias("item_id"), name.alias("original_filename"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("file_pos")
    )
    return item_source.project_label(items, files)


IDENTITIES = Proxy(
    "orders",
    {
        "k": "o_orderkey",
        "account": "case o_custkey % 4 when 0 then 'acc' when 1 then '' else cast(null as string) end",
        "board_account": "case o_custkey % 8 when 1 then 'bacc' when 3 then 'bacc' else cast(null as string) end",
        "board_id": "case o_orderkey % 5 when 0 then cast(null as string) else 'b1' end",
        "flat_board": "case when o_orderkey % 10 = 0 then 'b7' else cast(null as string) end",
        "id": "case when o_orderkey % 9 = 0 then '' else cast(o_orderkey as string) end",
        "group_id": "case when o_custkey % 6 = 0 then cast(null as string) else 'g1' end",
        "flat_group": "'g9'",
    },
)


@query(
    "item_identities",
    f"""
    with i as (select k, coalesce(nullif(account, ''), board_account, 'fallback') as a, coalesce(board_id, flat_board) as b, nullif(id, '') as i, coalesce(group_id, flat_group) as g from {IDENTITIES.sql})
    select a as account_id, b as board_id, i as item_id, g as group_id, a || ':' || b || ':' || i as external_task_key,
      concat_ws(',', case when b is null then 'board_missing' end, case when i is null then 'item_missing' end) as errors from i
    """,
)
def item_identities(spark, sf):
    rows = IDENTITIES.df(spark, sf)
    text = F.lit(None).cast("string")
    shaped = rows.select(
        F.struct(F.col("account").alias("id")).alias("account"),
        F.struct(F.col("board_id").alias("id"), F.struct(F.col("board_account").alias("id")).alias("account")).alias("board"),
        text.alias("account_id"),
        F.col("flat_board").alias("board_id"),
        "id",
        text.alias("item_id"),
        F.struct(F.col("group_id").alias("id"), text.alias("title")).alias("group"),
        F.col("flat_group").alias("group_id"),
        text.alias("group_title"),
        text.alias("updated_at"),
        F.lit(None).cast(schemas.ITEM["assets"].dataType).alias("assets"),
        F.lit(None).cast(schemas.ITEM["updates"].dataType).alias("updates"),
    )
    out = item_source.resolve_identity(shaped, "fallback")
    return out.select("account_id", "board_id", "item_id", "group_id", "external_task_key", F.array_join("errors", ",").alias("errors"))


_PROBLEM = """case when flaw = 3 then 'asset_metadata_missing' when flaw = 0 then 'size_invalid' when flaw = 1 then 'created_at_invalid' when flaw = 2 then 'url_missing' end"""


@query(
    "intake_contract",
    f"""
    with n as (select *, row_number() over (partition by item_id order by {_ORDER}) as asset from {LINES.sql}),
    p as (select item_id, string_agg({_PROBLEM}, ',' order by asset) as problems, count(*) as mails,
        sha256('[' || string_agg('{{"assetId":"' || asset || '","createdAt":"2026-01-02T03:04:05Z","filename":"' || filename || '","size":' || pos || '}}', ',' order by asset) || ']') as revision
      from n where filename like '%.eml' group by 1),
    o as (select distinct item_id, item_id::bigint as k from {LINES.sql}),
    e as (select o.k, o.item_id, concat_ws(',', case when k % 11 = 0 then 'board_missing' end, case when k % 17 = 0 then 'item_id_invalid' end, case when k % 13 = 0 then 'state_missing' end,
        nullif(p.problems, '')) as errors, p.revision, p.mails from o left join p using (item_id))
    select k::varchar as doc, errors, case when errors = '' then revision end as input_revision, case when errors = '' then mails is null end as missing_email from e
    """,
)
def intake_contract(spark, sf):
    rows = LINES.df(spark, sf)
    place = F.struct("pos", "line", "price", "filename", "flaw")
    docs = rows.groupBy("item_id").agg(F.array_sort(F.collect_list(place)).alias("l"))
    numbered = docs.select("item_id", F.transform("l", lambda x, i: F.struct((i + 1).cast("string").alias("id"), x.alias("x"))).alias("l"))
    k = F.col("item_id").cast("long")
    files = F.to_json(
        F.struct(F.transform("l", lambda m: F.struct(F.concat(F.lit("00"), m["id"]).alias("assetId"), m["x"]["filename"].alias("name"))).alias("files"))
    )
    assets = F.transform(
        F.filter("l", lambda m: m["x"]["flaw"] != 3),
        lambda m: F.struct(
            m["id"].alias("id"),
            m["x"]["filename"].alias("name"),
            F.lit(None).cast("string").alias("file_extension"),
            F.when(m["x"]["flaw"] == 0, F.lit("-1")).otherwise(m["x"]["pos"].cast("string")).alias("file_size"),
            F.when(m["x"]["flaw"] != 2, F.lit("u")).alias("url"),
            F.lit("").alias("public_url"),
            F.when(m["x"]["flaw"] == 1, F.lit("2026-01-02T03:04:05")).otherwise("2026-01-02T04:04:05+01:00").alias("created_at"),
        ),
    )
    text = F.lit(None).cast("string")
    column = F.struct(
        F.struct(text.alias("title")).alias("column"),
        F.lit(vocab.EMAIL_COLUMN).alias("id"),
        F.lit("file").alias("type"),
        files.alias("value"),
        text.alias("text"),
        text.alias("display_value"),
    )
    items = numbered.select(
        F.col("item_id").alias("doc"),
        F.when(k % 17 == 0, F.lit("x1")).otherwise(F.concat(F.lit("00"), (k + 1).cast("string"))).alias("id"),
        F.when(k % 13 == 0, F.lit(" ")).otherwise("active").alias("state"),
        F.lit("n").alias("name"),
        F.struct(F.when(k % 11 != 0, F.lit("b1")).alias("id")).alias("board"),
        F.struct(F.lit("g1").alias("id")).alias("group"),
        assets.alias("assets"),
        F.array(column).alias("column_values"),
    )
    checked = quality.intake_contract(items.withColumn("name", F.col("doc")))
    return checked.select(
        F.col("name").alias("doc"), F.array_join("errors", ",").alias("errors"), "input_revision", "missing_email"
    )


MEMBERS = Proxy(
    "lineitem",
    {
        "item_id": "l_suppkey",
        "asset_id": "l_partkey % 97",
        "member_name": "case when l_partkey % 97 % 3 = 0 then 'a.pdf' when l_partkey % 97 % 3 = 1 then 'a.eml' else 'plain' end",
    },
)


@query(
    "membership_join",
    f"""
    with n as (select item_id, asset_id, count(*) as n from {MEMBERS.sql} group by 1, 2),
    a as (select distinct l_suppkey as item_id, l_partkey % 97 as asset_id from lineitem where l_returnflag = 'A' and l_quantity > 45)
    select m.item_id, m.asset_id, m.member_name, case when a.item_id is not null then case when m.asset_id % 2 = 0 then 'x.msg' else 'x.doc' end end as name,
      case when a.item_id is null and m.member_name = 'a.pdf' then 'dropped' when a.item_id is null then 'metadata_missing' when m.asset_id % 2 = 1 then 'dropped' when n.n > 1 then 'duplicate' else 'kept' end as verdict
    from {MEMBERS.sql} m join n using (item_id, asset_id) left join a using (item_id, asset_id)
    """,
)
def membership_join(spark, sf):
    assets = (
        table(spark, sf, "lineitem")
        .filter("l_returnflag = 'A' and l_quantity > 45")
        .selectExpr("l_suppkey as item_id", "l_partkey % 97 as asset_id")
        .distinct()
        .withColumn("name", F.when(F.col("asset_id") % 2 == 0, F.lit("x.msg")).otherwise("x.doc"))
        .withColumn("file_extension", F.lit(""))
    )
    return quality.membership_join(MEMBERS.df(spark, sf), assets)


@query(
    "duplicate_memberships",
    f"select item_id, asset_id, count(*) as n from {MEMBERS.sql} group by 1, 2 having count(*) > 1",
)
def duplicate_memberships(spark, sf):
    return quality.duplicates(MEMBERS.df(spark, sf), ["item_id", "asset_id"])


FINGERPRINTS = Proxy(
    "documents",
    {
        "path": "cast(doc_id as string)",
        "sha256": "case when lang = 'de' then 'other' else sha2(text, 256) end",
        "size_bytes": "case when lang = 'fr' then n_chars + 1 else n_chars end",
    },
)


@query(
    "fingerprint_audit",
    """
    select doc_id::varchar as path, case when source = 'src3' then 'missing' when lang = 'de' then 'hash_mismatch' when lang = 'fr' then 'size_mismatch' else 'ok' end as verdict from documents
    """,
)
def fingerprint_audit(spark, sf):
    scanned = table(spark, sf, "documents").filter("source <> 'src3'").selectExpr(
        "cast(doc_id as string) as path", "sha2(text, 256) as sha256", "n_chars as size_bytes"
    )
    return quality.fingerprint_audit(FINGERPRINTS.df(spark, sf), scanned).select("path", "verdict")


_OLD = "select o_orderkey, o_custkey, 'old' as state from orders where o_orderstatus <> 'P'"


@query(
    "file_upsert",
    """
    select o_orderkey::varchar as asset_id, case when o_orderstatus = 'F' then 'kept' when o_orderstatus = 'O' then 'id-' || o_orderkey else 'new-' || o_orderkey end as id,
      case when o_orderstatus = 'F' then 'old' else 'new' end as original_filename, o_orderstatus = 'F' as has_deletion from orders
    """,
)
def file_upsert(spark, sf):
    orders = table(spark, sf, "orders")

    def rows(where, ident, name, deleted):
        return orders.filter(where).select(
            F.lit("t").alias("external_task_key"),
            F.lit("s").alias("snapshot_id"),
            F.col("o_orderkey").cast("string").alias("asset_id"),
            ident.alias("id"),
            F.lit(name).alias("original_filename"),
            (F.col("o_orderdate").cast("timestamp") if deleted else F.lit(None).cast("timestamp")).alias("deleted_at"),
            F.lit("e" if deleted else None).cast("string").alias("delete_error"),
        )

    key = F.col("o_orderkey").cast("string")
    stored = F.when(F.col("o_orderstatus") == "F", F.lit("kept")).otherwise(F.concat(F.lit("id-"), key))
    existing = rows("o_orderstatus <> 'P'", stored, "old", True)
    incoming = rows("o_orderstatus <> 'F'", F.concat(F.lit("new-"), key), "new", False)
    merged = ingest.upsert_files(existing, incoming)
    return merged.select("asset_id", "id", "original_filename", F.col("deleted_at").isNotNull().alias("has_deletion"))


@query(
    "insert_missing_users",
    """
    select c_custkey::varchar as id, 'known' as provider from customer where c_nationkey < 10
    union all select distinct o_custkey::varchar, 'new' from orders where o_custkey not in (select c_custkey from customer where c_nationkey < 10)
    """,
)
def insert_missing_users(spark, sf):
    known = table(spark, sf, "customer").filter("c_nationkey < 10").select(F.col("c_custkey").cast("string").alias("id"), F.lit("known").alias("provider"))
    incoming = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.lit("new").alias("provider"))
    return ingest.insert_missing(known, incoming, ["id"])


@query(
    "warning_merge",
    """
    select o_orderkey, concat_ws('|', o_orderpriority, 'b', case when o_orderstatus <> o_orderpriority then o_orderstatus end) as warnings from orders
    """,
)
def warning_merge(spark, sf):
    merged = ingest.append_warnings(F.array("o_orderpriority", F.lit("b")), F.array(F.lit("b"), F.col("o_orderstatus"), F.col("o_orderstatus")))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(merged, "|").alias("warnings"))


_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(
    "row_numbers",
    f"select l_returnflag, {', '.join(_LINE_ORDER)}, row_number() over (partition by l_returnflag order by {', '.join(_LINE_ORDER)})::int as row_index from lineitem",
)
def row_numbers(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_returnflag", *_LINE_ORDER)
    return number_rows(lines, ["l_returnflag"], [F.col(c) for c in _LINE_ORDER])


@query(
    "attachment_cap",
    f"""
    select l_suppkey, l_returnflag, l_orderkey, l_linenumber, l_partkey from lineitem
    qualify row_number() over (partition by l_suppkey, l_returnflag order by {', '.join(_LINE_ORDER)}) <= 8
    """,
)
def attachment_cap(spark, sf):
    lines = table(spark, sf, "lineitem")
    kept = top_k(lines, ["l_suppkey", "l_returnflag"], [F.col(c) for c in _LINE_ORDER], vocab.ATTACHMENTS_PER_KIND)
    return kept.select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey")
