"""Exact search and evidence selection against literal values and brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from worklens.operators import models, retrieval

CANDIDATE = "request_id string, chunk_id string, query_index int, score double, file_id string, cand_pos int"


def candidates(spark, rows):
    df = spark.createDataFrame(rows, CANDIDATE)
    return df.withColumn("filename", F.lit(None).cast("string")).withColumn("matched_query", F.concat(F.lit("q"), "query_index"))


def picked(df):
    return [r.chunk_id for r in df.orderBy("position").collect()]


GOLDEN = [
    ("r", "shared", 0, 0.4, "file-shared", 1),
    ("r", "query-0-a", 0, 0.2, "file-a", 2),
    ("r", "query-0-b", 0, 0.3, "file-a", 3),
    ("r", "shared", 1, 0.1, "file-shared", 4),
    ("r", "query-1-a", 1, 0.2, "file-b", 5),
    ("r", "query-1-b", 1, 0.3, "file-c", 6),
    ("r", "query-2-a", 2, 0.2, "file-d", 7),
]


def test_diverse_evidence_golden(spark):
    rows = retrieval.diverse_evidence(candidates(spark, GOLDEN), 6, 1)
    assert picked(rows) == ["shared", "query-1-a", "query-2-a", "query-0-a", "query-1-b"]
    first = rows.filter("position = 1").first()
    assert (first.score, first.matched_query_indexes, first.selected_by_index) == (0.1, [0, 1], 0)
    assert len(picked(retrieval.diverse_evidence(candidates(spark, GOLDEN), 4, 3))) == 4


def test_limits_are_the_callers(spark):
    rows = [("r", f"{f}-{i}", 0, i / 10, f, 5 * n + i) for n, f in enumerate("abcde") for i in range(5)]
    got = retrieval.diverse_evidence(candidates(spark, rows), 100, 100).collect()
    assert len(got) == len(rows)
    got = retrieval.diverse_evidence(candidates(spark, rows), 9, 2).collect()
    assert len(got) == 9 and max(sum(r.file_id == f for r in got) for f in "abcde") == 2
    assert retrieval.diverse_evidence(candidates(spark, rows), 0, 3).count() == 0


def plain_selection(rows, limit, per_file):
    """The rule on unpruned candidates: round-robin, one pick per query and round."""
    buckets, best = {}, {}
    for _, chunk, q, score, file, pos in sorted(rows, key=lambda r: (r[2], r[5])):
        if chunk not in buckets.setdefault(q, []):
            buckets[q].append(chunk)
        if chunk not in best or score < best[chunk][0]:
            best[chunk] = (score, file)
    out, used, alive = [], {}, True
    while alive and len(out) < limit:
        alive = False
        for q in sorted(buckets):
            if len(out) == limit:
                break
            while buckets[q]:
                chunk = buckets[q].pop(0)
                file = best[chunk][1]
                if chunk in out or used.get(file, 0) == per_file:
                    continue
                out.append(chunk)
                used[file] = used.get(file, 0) + 1
                alive = True
                break
    return out


def test_pruning_keeps_the_selection(spark):
    rng = random.Random(11)
    rows, expected = [], {}
    for n in range(60):
        limit, per_file = 12, 3
        mine = []
        for q in range(rng.randint(1, 3)):
            chunks = rng.sample(range(120), rng.randint(1, 90))
            mine += [(f"r{n}", f"c{c:03d}", q, rng.randint(0, 5) / 10, f"f{c % rng.choice([2, 5, 30])}", i) for i, c in enumerate(chunks)]
        # One file per chunk, as in a chunk table.
        owner = {}
        mine = [(*r[:4], owner.setdefault(r[1], r[4]), r[5]) for r in mine]
        rows += mine
        expected[f"r{n}"] = plain_selection(mine, limit, per_file)
    got = retrieval.diverse_evidence(candidates(spark, rows)).orderBy("request_id", "position").collect()
    for request, chunks in expected.items():
        assert [r.chunk_id for r in got if r.request_id == request] == chunks


def test_blocked_search_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    # One task holds most chunks and most queries, and is cut into many blocks.
    sizes = {"hot": (300, 40), "small": (7, 2), "unasked": (20, 0), "empty": (0, 1)}
    chunk_rows, query_rows, expected = [], [], {}
    for task, (n_chunks, n_queries) in sizes.items():
        vectors = rng.normal(size=(n_chunks, 8)).astype("float32")
        if n_chunks:
            vectors[0] = 0
        ids = [f"{task}-{i:04d}" for i in range(n_chunks)]
        chunk_rows += [(task, i, v.tolist()) for i, v in zip(ids, vectors)]
        for q in range(n_queries):
            vector = rng.normal(size=8)
            query_rows.append((task, f"{task}-q{q}", q % 3, vector.tolist()))
            with np.errstate(divide="ignore", invalid="ignore"):
                wide = vectors.astype("float64")
                d = 1 - wide @ vector / (np.linalg.norm(wide, axis=1) * np.linalg.norm(vector))
            order = sorted(range(n_chunks), key=lambda i: (np.isnan(d[i]), d[i] if not np.isnan(d[i]) else 0, ids[i]))[:8]
            expected[f"{task}-q{q}"] = [ids[i] for i in order]
    chunks = spark.createDataFrame(chunk_rows, "external_task_key string, chunk_id string, embedding array<float>")
    queries = spark.createDataFrame(query_rows, "external_task_key string, request_id string, query_index int, vector array<double>")
    rows = retrieval.search(chunks, queries, 8, chunks_per_block=50, queries_per_block=7).orderBy("cand_pos").collect()
    for request, ids in expected.items():
        assert [r.chunk_id for r in rows if r.request_id == request] == ids
    last = [r for r in rows if r.request_id == "small-q0"][-1]
    assert last.chunk_id == "small-0000" and np.isnan(last.score)


def test_plan_sanitising(spark):
    schema = "search_queries array<string>, question string, third_search_justified boolean"
    cases = [
        ((["  Roof   U-value  ", "roof u-VALUE", "Roof falls"], "q", False), ["Roof U-value", "Roof falls"]),
        ((["U-values", "roof falls", "drainage"], "q", False), ["U-values", "roof falls"]),
        ((["U-values", "roof falls", "drainage"], "q", True), ["U-values", "roof falls", "drainage"]),
        ((None, "  Original   question  ", False), ["Original question"]),
        ((["  "], "  Original   question  ", False), ["Original question"]),
        (([], "Original question", False), []),
        ((None, " ", None), []),
    ]
    df = spark.createDataFrame([c for c, _ in cases], schema)
    assert [r[0] for r in df.select(retrieval.sanitize_plan(limit=2, compound_limit=3)).collect()] == [e for _, e in cases]


def test_citations_drop_unknown_and_repeated_ids(spark):
    evidence = spark.createDataFrame([("r", "chunk-1", 1), ("r", "chunk-2", 2)], "request_id string, chunk_id string, position int")
    cited = spark.createDataFrame([("r", ["chunk-2", "unknown", "chunk-2"])], "request_id string, cited_chunk_ids array<string>")
    assert [(r.chunk_id, r.source_id) for r in retrieval.cited_evidence(evidence, cited).collect()] == [("chunk-2", "S2")]


def test_pluggable_models(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(10)], "id int, chunk_text string")

    def make_client():
        return lambda texts: [[float(len(t)), float(t[-1])] for t in texts]

    for row in models.embed_with(df, make_client, batch_size=3).collect():
        expected = np.array([len(row.chunk_text), float(row.id)])
        assert np.allclose(row.embedding, expected / np.linalg.norm(expected), atol=1e-6)

    def make_extractor():
        def extract(content, name):
            if name == "bad":
                raise ValueError("broken")
            return content.decode() + "!"

        return extract

    files = spark.createDataFrame([("p1", "ok", b"abc"), ("p2", "bad", b"")], "path string, filename string, content binary")
    got = {r.path: (r.text, r.error) for r in models.extract_texts(files, make_extractor).collect()}
    assert got == {"p1": ("abc!", None), "p2": (None, "Error processing bad: broken")}

    def make_planner():
        def plan(question):
            if question == "fail":
                raise RuntimeError
            return {"search_queries": [question, "more"], "third_search_justified": True}

        return plan

    asked = spark.createDataFrame([(1, "fail"), (2, "roof")], "request_id int, question string")
    plans = {r.request_id: r for r in models.plan_with(asked, make_planner).withColumn("q", retrieval.sanitize_plan(limit=2, compound_limit=3)).collect()}
    assert plans[1].search_queries is None and plans[1].q == ["fail"]
    assert plans[2].q == ["roof", "more"]

    texts = spark.createDataFrame([(1, "Scale: 1:50"), (2, "x")], "item_id int, all_text string")

    def make_fields():
        return lambda t: {"Scale": "1:50"} if "Scale" in t else 1 / 0

    got = {r.item_id: (r.fields, r.error) for r in models.extract_fields(texts, make_fields).collect()}
    assert got[1] == ({"Scale": "1:50"}, None) and got[2][0] == {} and "zero" in got[2][1]
