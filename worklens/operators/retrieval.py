"""Retrieval: plans, exact top-k search, diverse evidence, citations."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from worklens import vocab
from worklens.functions import text
from worklens.plans.lifecycle import KEY, latest_complete
from worklens.scale import number_rows, top_k
from worklens.session import written

CHUNKS_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 256


def sanitize_plan(
    queries: Column | str = "search_queries",
    question: Column | str = "question",
    third: Column | str = "third_search_justified",
    limit: int | None = None,
    compound_limit: int | None = None,
) -> Column:
    """Distinct, collapsed search queries of a plan, first spelling kept.

    All of them, unless the caller sets ``limit``, or ``compound_limit`` for plans
    whose third search is justified.

    A missing plan, or one with only blank queries, falls back to the question;
    an empty plan stays empty. Plans are short arrays, so no shuffle is needed.
    """
    raw = text.col(queries)
    fallback = text.collapse(question)
    fallback = F.when(fallback != "", F.array(fallback)).otherwise(F.array().cast("array<string>"))
    cleaned = F.filter(F.transform(raw, text.collapse), lambda q: q != "")
    everything = 2**31 - 1
    most = F.when(F.coalesce(text.col(third), F.lit(False)), F.lit(compound_limit or limit or everything)).otherwise(
        F.lit(limit or everything)
    )
    bound = F.array(F.struct(cleaned.alias("q"), F.transform(cleaned, F.lower).alias("k")))
    kept = F.transform(
        bound, lambda b: F.filter(b["q"], lambda q, i: F.array_position(b["k"], F.lower(q)) == i + 1)
    )[0]
    return (
        F.when(raw.isNull(), fallback)
        .when(F.size(raw) == 0, F.array().cast("array<string>"))
        .when(F.size(kept) == 0, fallback)
        .otherwise(F.slice(kept, F.lit(1), most))
    )


def query_rows(requests: DataFrame, queries: Column | str = "queries") -> DataFrame:
    """One row per usable query (stripped, non-blank): query_index from 0."""
    stripped = F.filter(F.transform(text.col(queries), text.strip), lambda q: q != "")
    return requests.select("request_id", KEY, F.posexplode(stripped).alias("query_index", "query"))


def chunks_in_scope(chunks: DataFrame, files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Chunks of the files of the latest complete snapshot of every task."""
    latest = latest_complete(snapshots).select(KEY, F.col("id").alias("snapshot_id"))
    current = files.join(latest, [KEY, "snapshot_id"]).select(
        F.col("id").alias("file_id"), KEY, F.col("original_filename").alias("filename"), "asset_id"
    )
    return chunks.join(current, "file_id")


def search(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = vocab.CANDIDATES_PER_QUERY,
    chunks_per_block: int = CHUNKS_PER_BLOCK,
    queries_per_block: int = QUERIES_PER_BLOCK,
) -> DataFrame:
    """Exact cosine top-k chunks of every query inside its task.

    chunks: external_task_key, chunk_id, embedding; queries: external_task_key,
    request_id, query_index, vector. Large tasks are cut into blocks of chunks
    and blocks of queries; each pair of blocks is one matrix product that emits
    only its own best ``k`` rows per query, never all pairs. Vectors are
    shuffled once and chunks of tasks nobody asks about are dropped before.
    """
    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy(KEY).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(size))).cast("int").alias(name))

    # One small row per asked task; written, so that its size decides the join strategy.
    layout = written(
        blocks(queries, queries_per_block, "_query_blocks").join(blocks(chunks, chunks_per_block, "_chunk_blocks"), KEY),
        "search-layout",
    )
    left = chunks.join(layout, KEY).select(
        KEY,
        "chunk_id",
        F.col("embedding").cast("array<float>").alias("embedding"),
        F.pmod(F.xxhash64("chunk_id"), F.col("_chunk_blocks")).cast("int").alias("_cb"),
        F.explode(F.sequence(F.lit(0), F.col("_query_blocks") - 1)).alias("_qb"),
    )
    right = queries.join(layout, KEY).select(
        KEY,
        "request_id",
        "query_index",
        F.col("vector").cast("array<double>").alias("vector"),
        F.explode(F.sequence(F.lit(0), F.col("_chunk_blocks") - 1)).alias("_cb"),
        F.pmod(F.xxhash64("request_id", "query_index"), F.col("_query_blocks")).cast("int").alias("_qb"),
    )
    types = {f.name: f.dataType.simpleString() for f in [*chunks.schema, *queries.schema]}
    schema = f"request_id {types['request_id']}, query_index int, chunk_id {types['chunk_id']}, score double"

    def block_top_k(chunk_block: pd.DataFrame, query_block: pd.DataFrame) -> pd.DataFrame:
        columns = ["request_id", "query_index", "chunk_id", "score"]
        if chunk_block.empty or query_block.empty:
            return pd.DataFrame(columns=columns)
        c = np.stack(chunk_block["embedding"].to_numpy()).astype("float64")
        q = np.stack(query_block["vector"].to_numpy()).astype("float64")
        with np.errstate(divide="ignore", invalid="ignore"):
            lengths = np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1))
            distance = 1.0 - (q @ c.T) / lengths
        ids = chunk_block["chunk_id"].to_numpy()
        picks = []
        for row in distance:
            near = np.arange(len(row))
            if len(row) > k:
                # Only what is not behind the k-th best is sorted; NaN lies behind everything.
                edge = np.partition(row, k - 1)[k - 1]
                near = near if np.isnan(edge) else np.flatnonzero(row <= edge)
            near = near[np.argsort(ids[near], kind="stable")]
            picks.append(near[np.argsort(row[near], kind="stable")][:k])
        rows = np.repeat(np.arange(len(q)), [len(p) for p in picks])
        flat = np.concatenate(picks)
        return pd.DataFrame(
            {
                "request_id": query_block["request_id"].to_numpy()[rows],
                "query_index": query_block["query_index"].to_numpy()[rows],
                "chunk_id": ids[flat],
                "score": distance[rows, flat],
            },
            columns=columns,
        )

    group = [KEY, "_cb", "_qb"]
    partial = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(block_top_k, schema)
    # The distance to a zero vector is NaN and sorts last; pandas hands it over as NULL.
    partial = partial.withColumn("score", F.coalesce("score", F.lit(float("nan"))))
    return top_k(partial, ["request_id", "query_index"], [F.col("score"), F.col("chunk_id")], k, "cand_pos")


def batch_candidates(
    requests: DataFrame,
    chunks: DataFrame,
    files: DataFrame,
    snapshots: DataFrame,
    embed: Callable[[DataFrame], DataFrame],
    k: int = vocab.CANDIDATES_PER_QUERY,
) -> DataFrame:
    """Candidates of all requests: queries, vectors, search, then chunk details.

    ``embed`` adds ``vector`` to a frame with ``query``.
    """
    asked = embed(query_rows(requests))
    scope = chunks_in_scope(chunks.withColumnRenamed("id", "chunk_id"), files, snapshots)
    # A few rows per query: written, so that the chunk texts are not shuffled to meet them.
    found = written(search(scope, asked, k), "candidates")
    details = scope.select("chunk_id", "file_id", "filename", "asset_id", "page", "section", F.col("chunk_text").alias("snippet"))
    queries = asked.select("request_id", "query_index", F.col("query").alias("matched_query"))
    return found.join(queries, ["request_id", "query_index"]).join(details, "chunk_id")


def merge_candidates(candidates: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per (request, chunk): best-scored candidate and all matching queries.

    The lowest score wins, the first arrival on ties; a missing score counts as
    infinite. Arrival order is (query_index, cand_pos).
    """
    usable = candidates.filter(
        F.col("query_index").isNotNull() & (F.length(F.coalesce(F.col("chunk_id").cast("string"), F.lit(""))) > 0)
    )
    rank = F.struct(
        F.coalesce("score", F.lit(float("inf"))).alias("s"), F.col("query_index").alias("q"), F.col("cand_pos").alias("p")
    )
    details = F.struct("score", "file_id", "filename", *extra)
    per_query = usable.groupBy("request_id", "chunk_id", "query_index").agg(
        F.min("cand_pos").alias("cand_pos"),
        F.min_by("matched_query", "cand_pos").alias("matched_query"),
        F.min_by(F.struct(rank.alias("r"), details.alias("d")), rank).alias("_best"),
    )
    merged = per_query.groupBy("request_id", "chunk_id").agg(
        F.min_by("_best.d", "_best.r").alias("_d"),
        F.array_sort(F.collect_list(F.struct("query_index", "cand_pos", "matched_query"))).alias("_hits"),
    )
    return merged.select(
        "request_id",
        "chunk_id",
        "_d.*",
        F.transform("_hits", lambda h: h["query_index"]).alias("matched_query_indexes"),
        F.transform("_hits", lambda h: h["matched_query"]).alias("matched_queries"),
        F.col("_hits").alias("hits"),
    )


def _greedy(evidence_limit: int, file_limit: int):
    def pick(group: pd.DataFrame) -> pd.DataFrame:
        buckets = [
            (index, bucket.sort_values("cand_pos").to_dict("records"))
            for index, bucket in group.groupby("query_index", sort=True)
        ]
        waiting = [iter(rows) for _, rows in buckets]
        taken: dict[object, int] = {}
        per_file: dict[object, int] = {}
        picks: list[tuple] = []
        progress = True
        while progress and len(picks) < evidence_limit:
            progress = False
            for (index, _), rows in zip(buckets, waiting):
                if len(picks) >= evidence_limit:
                    break
                for row in rows:
                    if row["chunk_id"] in taken or per_file.get(row["file_key"], 0) >= file_limit:
                        continue
                    taken[row["chunk_id"]] = index
                    per_file[row["file_key"]] = per_file.get(row["file_key"], 0) + 1
                    picks.append((row["request_id"], row["chunk_id"], len(picks) + 1, index, row["matched_query"]))
                    progress = True
                    break
        return pd.DataFrame(
            picks, columns=["request_id", "chunk_id", "position", "selected_by_index", "selected_by_query"]
        )

    return pick


def diverse_evidence(
    candidates: DataFrame,
    max_evidence: int = vocab.MAX_EVIDENCE,
    max_per_file: int = vocab.MAX_PER_FILE,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """Evidence per request: round-robin over its queries, few chunks per file.

    Before the greedy step every bucket is cut to rows that can still be picked:
    a row behind ``max_per_file`` rows of the same file never is, and at most
    ``3 * max_evidence`` rows of a bucket can be looked at before the evidence is
    full. So a group stays as small as the evidence asked for and the result is
    the same.
    """
    evidence_limit, file_limit = max_evidence, max_per_file
    # A few rows per query, read twice below: written, so that the search runs once.
    merged = written(merge_candidates(candidates, extra), "merged-candidates")
    if evidence_limit <= 0 or file_limit <= 0:
        merged = merged.filter(F.lit(False))
    file_key = F.coalesce(
        F.nullif(F.col("file_id").cast("string"), F.lit("")),
        F.nullif("filename", F.lit("")),
        F.concat(F.lit("chunk:"), F.col("chunk_id").cast("string")),
    )
    bucket = merged.select("request_id", "chunk_id", file_key.alias("file_key"), F.explode("hits").alias("h")).select(
        "request_id", "chunk_id", "file_key", "h.query_index", "h.cand_pos", "h.matched_query"
    )
    order = [F.col("cand_pos"), F.col("chunk_id")]
    bucket = top_k(bucket, ["request_id", "query_index", "file_key"], order, max(file_limit, 1))
    bucket = top_k(bucket, ["request_id", "query_index"], order, 3 * max(evidence_limit, 1))
    types = dict(bucket.dtypes)
    schema = (
        f"request_id {types['request_id']}, chunk_id {types['chunk_id']}, position int, "
        "selected_by_index int, selected_by_query string"
    )
    picks = bucket.groupBy("request_id").applyInPandas(_greedy(evidence_limit, file_limit), schema)
    return picks.join(merged.drop("hits"), ["request_id", "chunk_id"])


def cited_evidence(evidence: DataFrame, cited: DataFrame) -> DataFrame:
    """Evidence in cited order; unknown and repeated ids are dropped.

    cited: request_id, cited_chunk_ids.
    """
    wanted = cited.select("request_id", F.posexplode("cited_chunk_ids").alias("cited_pos", "chunk_id"))
    first = wanted.groupBy("request_id", "chunk_id").agg(F.min("cited_pos").alias("cited_pos"))
    source = F.concat(F.lit("S"), F.col("position").cast("string"))
    return evidence.join(first, ["request_id", "chunk_id"]).withColumn("source_id", source)


def citations_for_display(cited: DataFrame, limit: int | None = None) -> DataFrame:
    """The cited sources, or the first ``limit`` of them, with their display section and cleaned snippet."""
    shown = top_k(cited, ["request_id"], [F.col("cited_pos")], limit or 2**31 - 1, "display_pos")
    return shown.withColumn("snippet", text.evidence_snippet("snippet", "section", "filename")).withColumn(
        "section", text.display_section("section")
    )


def evidence_payload(evidence: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Numbered evidence as it is handed to an answer model; snippets are whole unless cut to ``max_chars``."""
    snippet = text.limited(text.evidence_snippet("snippet", "section", "filename"), max_chars)
    return evidence.select(
        "request_id",
        "position",
        F.concat(F.lit("S"), F.col("position").cast("string")).alias("source_id"),
        "chunk_id",
        "filename",
        "section",
        snippet.alias("snippet"),
        "score",
        "matched_queries",
        "selected_by_query",
    )


def fallback_answers(
    requests: DataFrame,
    evidence: DataFrame,
    details_shown: int | None = None,
    excerpts_shown: int | None = None,
    detail_chars: int | None = None,
    excerpt_chars: int | None = None,
) -> DataFrame:
    """Grounded answer without a model: details and excerpts, all and whole unless limited.

    requests: request_id, corpus_wide_requested, context
    (``array<struct<key,value>>`` in document order).
    """
    filled = F.filter(
        "context", lambda d: d["value"].isNotNull() & ~d["value"].isin("", "[]", "{}")
    )
    details = F.transform(
        F.slice(filled, 1, details_shown or 2**31 - 1), lambda d: F.concat(d["key"], F.lit(": "), text.limited(d["value"], detail_chars))
    )
    cleaned = text.evidence_snippet("snippet", "section", "filename")
    excerpts = (
        evidence.filter(F.col("position") <= (excerpts_shown or 2**31 - 1))
        .select("request_id", "position", cleaned.alias("snippet"))
        .filter("snippet <> ''")
        .groupBy("request_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("position", text.limited("snippet", excerpt_chars).alias("t")))).alias("_e")
        )
        .select("request_id", F.transform("_e", lambda e: e["t"]).alias("_excerpts"))
    )
    none = F.array().cast("array<string>")
    df = requests.select("request_id", "corpus_wide_requested", details.alias("_details")).join(excerpts, "request_id", "left")
    df = df.withColumn("_excerpts", F.coalesce("_excerpts", none)).withColumn("_details", F.coalesce("_details", none))
    has_details, has_excerpts = F.size("_details") > 0, F.size("_excerpts") > 0
    lines = F.array_compact(
        F.array(
            F.lit(vocab.FALLBACK_OPENING),
            F.when(F.col("corpus_wide_requested"), F.lit(vocab.FALLBACK_PARTIAL)),
            F.when(has_details, F.concat(F.lit("Task details: "), F.array_join("_details", "; "))),
            F.when(has_excerpts, F.concat(F.lit("Relevant source excerpts: "), F.array_join("_excerpts", " | "))),
            F.when(~has_details & ~has_excerpts, F.lit(vocab.FALLBACK_NOTHING)),
        )
    )
    return df.select("request_id", F.array_join(lines, "\n\n").alias("answer"))


def recent_history(messages: DataFrame, limit: int, max_chars: int | None = None) -> DataFrame:
    """The last ``limit`` messages of every conversation; blank ones drop out afterwards.

    messages: conv_id, turn, role, text.
    """
    last = top_k(messages, ["conv_id"], [F.col("turn").desc()], limit)
    return last.withColumn("content", text.limited("text", max_chars)).filter("content <> ''").drop("text")


def running_history(messages: DataFrame, limit: int, max_chars: int | None = None, slice_rows: int = 4096) -> DataFrame:
    """For every message the last ``limit`` messages of its conversation up to and with itself.

    messages: conv_id, turn, role, text. Returns conv_id, turn, position and ``history``, an array of
    (turn, role, content) from which blank messages have dropped out. Messages of one turn are ordered by
    role and text, null turns come first. A conversation is cut into slices that carry the last rows of the
    slice before, so one of any length is framed by many tasks.
    """
    if limit > slice_rows:
        raise ValueError("a slice must hold the whole history of a message")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    numbered = number_rows(messages.select("conv_id", "turn", "role", "text"), ["conv_id"], order, "position")
    own = F.floor((F.col("position") - 1) / slice_rows).cast("long")
    edge = (F.col("position") - 1) % slice_rows >= slice_rows - (limit - 1)
    slices = F.explode(F.when(edge, F.array(own, own + 1)).otherwise(F.array(own))).alias("_slice")
    placed = numbered.select("*", own.alias("_own"), slices)
    message = F.struct("turn", "role", text.limited("text", max_chars).alias("content"))
    window = Window.partitionBy("conv_id", "_slice").orderBy("position").rowsBetween(1 - limit, Window.currentRow)
    framed = placed.withColumn("history", F.collect_list(message).over(window)).filter(F.col("_slice") == F.col("_own"))
    history = F.filter("history", lambda m: m["content"] != "").alias("history")
    return framed.select("conv_id", "turn", "position", history)
