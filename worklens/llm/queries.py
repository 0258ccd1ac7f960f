"""The operators over the given tables, each with an equivalent SQL statement where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from worklens.llm import (
    alignment,
    conversation_repair,
    decontamination,
    jaccard_join,
    language_crf,
    packing,
    piece_bpe,
    pitman_yor,
    quality,
    sharding,
    token_rollup,
    url_filter,
    vector_search,
)
from worklens.llm.common import in_fold
from worklens.session import new_shared_path, written

Build = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Build, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        REGISTRY[name] = (build, sql)
        return build

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- 1: language identification


@query("op1_language_crf")
def op1_language_crf(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = in_fold("doc_id", 4, 2)
    model = language_crf.fit(docs, ~held_out)
    scored = language_crf.with_language(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


# --- 2: URL filters

#: Rules of the production list (host, path, verdict).
URL_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


@query(
    "op2_url_filter",
    rf"""
    with rules(rule_host, rule_path, rule_verdict) as (values {_RULES_SQL}),
    parts as (
        select page_id, case when position('://' in url) > 0 then substring(url, position('://' in url) + 3) end as rest
        from pages
    ),
    split as (
        select page_id,
            coalesce(translate(regexp_extract(rest, '^[^/?#]*'),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
            coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
        from parts
    ),
    best as (
        select s.page_id, s.host, s.path,
            max(struct_pack(n := length(rule_host || rule_path), h := length(rule_host), rule := rule_host || rule_path,
                verdict := rule_verdict)) as best
        from split s left join rules r
            on (s.host = rule_host or ends_with(s.host, '.' || rule_host)) and starts_with(s.path, rule_path)
        group by s.page_id, s.host, s.path
    )
    select page_id, host, path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict from best
    """,
)
def op2_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    judged = url_filter.url_verdicts(pages, rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


# --- 3: best-fit packing


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


# --- 4: sharding

SHARDS, SHARD_SEED = 40, 20240

_CRC_TABLE = """list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda c, i: case when (c & 1) = 1 then xor(3988292384, c >> 1) else c >> 1 end))"""
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint,
    list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: ('0x' || h)::bigint)),
    lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])))"""


def _network_sql(source: str) -> str:
    """One pass of the permutation's rounds over the column position of a relation with n and side."""
    rounds = f"(select *, position // side as l, position % side as r from {source})"
    for m, a, b in sharding.round_keys(SHARD_SEED):
        t = f"((r % {sharding.PRIME}) * {m} + {a}) % {sharding.PRIME}"
        rounds = f"(select * replace (r as l, (l + (({t}) * ({t}) + {b}) % {sharding.PRIME}) % side as r) from {rounds})"
    return f"select row_number, n, side, l * side + r as position from {rounds}"


_SHARD_SQL = f"""
    with recursive crc as materialized (select {_CRC_TABLE} as crc_table),
    bodies as (select doc_id, coalesce(text, '') as body from documents),
    sized as materialized (
        select doc_id, (strlen(body) + 16)::bigint as size, ({_CRC})::bigint as text_crc32 from bodies, crc
    ),
    numbered as materialized (
        select *, row_number() over (order by doc_id nulls first, text_crc32, size) - 1 as row_number from sized
    ),
    totals as (select count(*) as n, ceil(sqrt(count(*)))::bigint as side from sized),
    walk as (
        {_network_sql("(select row_number, n, side, row_number as position from numbered, totals)")}
        union all
        {_network_sql("(select * from walk where position >= n)")}
    )
    select doc_id, size, text_crc32, 'rows' as law, (position % {SHARDS})::int as shard,
        (position // {SHARDS})::bigint as slot, null::int as grown_shard, row_number
    from walk join numbered using (row_number) where position < n
    """


@query("op4_feistel_sharding", _SHARD_SQL)
def op4_feistel_sharding(spark: SparkSession, sf: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf, "documents"), SHARDS, SHARD_SEED)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


# --- 5: exact top-k search

SEARCH_K = 5


@query(
    "op5_exact_top_k",
    f"""
    with v as (
        select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as q
        from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ),
    scored as (
        select a.vec_id as query_id, b.vec_id, list_dot_product(a.q, b.q)::bigint as score
        from v a join v b on a.vec_id <> b.vec_id
        where a.vec_id % 50 = 0
    ),
    ranked as (
        select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
    )
    select query_id, rank::int as rank, vec_id, score from ranked where rank <= {SEARCH_K}
    """,
)
def op5_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    whole = F.transform("embedding", lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x.cast("double")).otherwise(F.floor(x.cast("double") * 256).cast("double")))
    scaled = vectors.select("vec_id", whole.alias("embedding"))
    return vector_search.top_k(scaled, scaled.filter(F.col("vec_id") % 50 == 0), SEARCH_K)


# --- 6: token counts

_WORDS_V1 = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
_WORDS_V2 = r"len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]'))"


@query(
    "op6_token_rollup",
    f"""
    with counted as (
        select doc_id, source, lang, {_WORDS_V1} as v1, {_WORDS_V2} as v2,
            row_number() over (partition by text order by doc_id) as copy
        from documents
    ),
    signed as (
        select source, lang, 'words_v1' as tokenizer, 1 as docs, v1 as tokens from counted
        union all select source, lang, 'words_v1', -1, -v1 from counted where copy > 1
        union all select source, lang, 'words_v1', -1, -v1 from counted where copy = 1 and lang is distinct from 'en'
        union all select source, lang, 'words_v2', 1, v2 from counted where copy = 1 and lang is distinct from 'en'
    )
    select source, lang, tokenizer, sum(docs)::bigint as docs, sum(tokens)::bigint as tokens
    from signed group by all having sum(docs) <> 0 or sum(tokens) <> 0
    """,
)
def op6_token_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Inserts every document, deletes exact copies, and recounts what is not English by the next version.

    The last batch is delivered twice, which must not change the totals.
    """
    docs = table(spark, sf, "documents")
    path = new_shared_path(spark, "token-rollup")
    # Counted once, so that no text is shuffled to find out which documents a batch is about.
    counted = docs.select(
        "doc_id",
        "lang",
        "source",
        F.sha2("text", 256).alias("digest"),
        token_rollup.words_v1(F.col("text")).alias("v1"),
        token_rollup.words_v2(F.col("text")).alias("v2"),
    )
    # Ids may be null or repeat, so rows are told apart by a number that is written with them.
    counted = written(counted.withColumn("row", F.monotonically_increasing_id()), "token-counts")
    v1, v2 = F.col("v1"), F.col("v2")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    first = written(counted.groupBy("digest").agg(F.min(order).alias("first")).select("first.row"), "first-copies")
    token_rollup.commit("0001-insert", token_rollup.inserted(counted, "words_v1", v1), path)
    token_rollup.commit("0002-delete", token_rollup.deleted(counted.join(first, "row", "left_anti"), "words_v1", v1), path)
    kept = counted.join(first, "row", "left_semi").filter(~F.col("lang").eqNullSafe("en"))
    for _ in range(2):
        token_rollup.commit("0003-revise", token_rollup.revised(kept, ("words_v1", v1), ("words_v2", v2)), path)
    return token_rollup.totals(spark, path)


# --- 7: n-gram Jaccard join


@query(
    "op7_jaccard_join",
    r"""
    with recursive words as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
        from documents
    ),
    sets as materialized (
        select doc_id, list_distinct(case
            when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
            when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as grams
        from words
    ),
    rows as materialized (select doc_id, unnest(grams) as gram from sets),
    met as (
        select a.doc_id as x, b.doc_id as y, count(*) as shared
        from rows a join rows b on a.gram = b.gram and a.doc_id <> b.doc_id group by all
    ),
    links as materialized (
        select x, y from met join sets a on a.doc_id = x join sets b on b.doc_id = y
        where 100 * shared >= 80 * (len(a.grams) + len(b.grams) - shared)
    ),
    reached as (
        select doc_id, doc_id as other from sets
        union
        select r.doc_id, l.y from reached r join links l on l.x = r.other
    )
    select doc_id, len(grams)::bigint as n_shingles, min(other) as component_id
    from sets join reached using (doc_id) group by all
    """,
)
def op7_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf, "documents"))


# --- 8: quality classifier

QUALITY_THRESHOLD = 0.3


@query("op8_quality_nbsvm")
def op8_quality_nbsvm(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf, "labels"), ~in_fold("doc_id", 5, 0))
    scored = quality.with_quality(docs, model)
    return scored.select(
        "doc_id",
        in_fold("doc_id", 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"),
    )


# --- 9: benchmark decontamination


@query("op9_benchmark_edit_matching")
def op9_benchmark_edit_matching(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.benchmark_hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


# --- 10: language-model scoring


@query("op10_pitman_yor")
def op10_pitman_yor(spark: SparkSession, sf: str) -> DataFrame:
    scored = pitman_yor.score_documents(table(spark, sf, "documents"), ~in_fold("doc_id", 7, 2))
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


# --- 11: SentencePiece encoding and decoding

PIECE_MODEL = "piece_bpe_32k.model"


@query("op11_piece_bpe")
def op11_piece_bpe(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf, "documents").select("doc_id", "text")
    encoded = piece_bpe.with_pieces(docs, public_tokenizers.path(PIECE_MODEL), into=("ids", "decoded"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


# --- 12: conversation structure repair


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with the faults that the query is about, by the CRC-32 of ``conv_id:turn``; nulls are one space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(key) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    hurt = rows.filter(fault != 0).select(
        "conv_id",
        "turn",
        F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("copies"),
    )
    return hurt.withColumn("copy", F.explode("copies")).select("conv_id", "turn", "role", "text")


#: Insertions before a message: state, letters, inserted lines, cost, state after.
_INSERTS_SQL = """(values (0, '', []::varchar[], 0, 0), (1, '', [], 0, 1), (2, '', [], 0, 2), (3, '', [], 0, 3),
    (0, 'I', ['user:'], 2, 2), (1, 'I', ['user:'], 2, 2), (2, 'I', ['assistant:'], 2, 3), (3, 'I', ['user:'], 2, 2),
    (0, 'II', ['user:', 'assistant:'], 4, 3), (1, 'II', ['user:', 'assistant:'], 4, 3),
    (2, 'II', ['assistant:', 'user:'], 4, 2), (3, 'II', ['user:', 'assistant:'], 4, 3)) as ins(q, letters, added, price, q2)"""

_REPAIR_SQL = rf"""
    with recursive crc as materialized (select {_CRC_TABLE} as crc_table),
    keyed as (
        select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
            coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as body
        from conversations
    ),
    marked as materialized (select *, ({_CRC}) % 20 as fault from keyed, crc),
    hurt as (
        select conv_id, turn, case when fault = 4 then 'user' else role end as role,
            case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
            unnest(case when fault = 3 then [1, 2] else [1] end) as copy
        from marked where fault <> 0
    ),
    placed as materialized (
        select *, dense_rank() over (order by conv_id nulls first) as g,
            row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
            regexp_replace(text, '[ 	-
]+$', '') as bare
        from hurt
    ),
    judged as materialized (
        select *, bare = '' as blank,
            bare <> '' and i > min(i) over (partition by g, role, text) as duplicate,
            bare <> '' and i = min(i) over (partition by g, role, text) and right(bare, 1) not in ('.', '!', '?') as truncated,
            left(role, 1) as initial,
            left(role, 1) || lead(left(role, 1)) over (partition by g order by i) as pair
        from placed
    ),
    dp as (
        select distinct g, 0::bigint as i, 0 as q, {{cost: 0, audit: '', lines: []::varchar[]}} as best from judged
        union all
        select g, i, q, min(best) from (
            select d.g, j.i, arcs.q2 as q, {{
                cost: best.cost + ins.price + arcs.price, audit: best.audit || ins.letters || arcs.letter,
                lines: best.lines || ins.added || case arcs.letter when 'D' then [] when 'K' then [j.role || ':' || j.text]
                    else [case arcs.q2 when 3 then 'assistant:' else 'user:' end || j.text] end }} as best
            from dp d join judged j on j.g = d.g and j.i = d.i + 1
            join {_INSERTS_SQL} on ins.q = d.q,
            lateral (
                select 'D' as letter, 3 as price, ins.q2 as q2
                union all
                select 'R', 2 + j.truncated::int, case ins.q2 when 2 then 3 else 2 end where not (j.blank or j.duplicate)
                union all
                select 'K', j.truncated::int, case j.initial when 's' then 1 when 'u' then 2 else 3 end
                where not (j.blank or j.duplicate) and (j.initial = 's' and ins.q2 = 0 or j.initial = 'u' and ins.q2 <> 2
                    or j.initial = 'a' and ins.q2 = 2)
            ) arcs
        ) group by g, i, q
    ),
    ends as (
        select d.g, min({{cost: best.cost + ins.price, audit: best.audit || ins.letters, lines: best.lines || ins.added}}) as best
        from dp d join (select g, max(i) as i from judged group by g) n using (g, i) join {_INSERTS_SQL} on ins.q = d.q
        where ins.q2 in (0, 3) group by d.g
    ),
    counts as (
        select conv_id, g, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
            count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated,
            count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
        from judged group by conv_id, g
    )
    select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank,
        coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
        coalesce(illegal, 0)::bigint as illegal, coalesce(best.cost, 0)::bigint as cost, coalesce(best.audit, '') as audit,
        sha256(coalesce(array_to_string(best.lines, chr(10)), '')) as repaired_sha256
    from (select distinct conv_id from conversations) e left join counts c on e.conv_id is not distinct from c.conv_id
    left join ends using (g)
    """


@query("op12_conversation_repair", _REPAIR_SQL)
def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    repaired = conversation_repair.repair(damaged(rows))
    every = rows.select("conv_id").distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    digests = conversation_repair.digests(repaired.edits).withColumnRenamed("conv", "_conv")
    found = repaired.summary.join(digests, F.col("conv").eqNullSafe(F.col("_conv")))
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


# --- 13: cross-tokenizer alignment

BYTE_MODEL = "byte_bpe_50k.json"


@query("op13_pair_bitmaps")
def op13_pair_bitmaps(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf, "documents").select("doc_id", "text")
    digest = F.when(F.col("n_links") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    chosen = [F.col("doc_id").cast("long").alias("doc_id"), *alignment.COUNTS, digest]
    paths = public_tokenizers.path(BYTE_MODEL), public_tokenizers.path(PIECE_MODEL)
    return alignment.align(docs, *paths, keep=["doc_id"], columns=chosen).documents
