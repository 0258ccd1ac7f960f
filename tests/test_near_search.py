"""Search over cells: exact with the bound, close to it without."""

import numpy as np
import pytest

from worklens.operators import near_search, retrieval

CHUNKS = "external_task_key string, chunk_id string, embedding array<float>"
QUERIES = "external_task_key string, request_id string, query_index int, vector array<double>"


def tables(spark, seed=1, n=1500, width=12, groups=20):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    rows = [("t" if i % 5 else "u", f"c{i:05d}", (centres[i % groups] + 0.25 * rng.normal(size=width)).astype("float32").tolist()) for i in range(n)]
    rows += [("t", "zero", [0.0] * width), ("t", "twin", rows[1][2]), ("v", "only", [1.0] * width), ("v", "void", [0.0] * width)]
    asked = [(("t", "u")[i % 2], f"r{i}", 0, (centres[i % groups] + 0.25 * rng.normal(size=width)).tolist()) for i in range(40)]
    asked += [("t", "null", 1, [0.0] * width), ("v", "few", 0, [1.0, *[0.0] * (width - 1)]), ("none", "lost", 0, [1.0] * width)]
    return spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(asked, QUERIES)


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.request_id, r.query_index), []).append((r.cand_pos, r.chunk_id, None if np.isnan(r.score) else round(r.score, 9)))
    return {key: sorted(rows) for key, rows in out.items()}


@pytest.mark.parametrize("cells,probes", [(1, 1), (16, 1), (200, 3)])
def test_exact_by_the_bound(spark, cells, probes):
    """Zero vectors, tasks with fewer chunks than asked, ties and tasks that nobody has."""
    chunks, queries = tables(spark)
    assert answers(near_search.near_search(chunks, queries, 8, cells=cells, probes=probes)) == answers(retrieval.search(chunks, queries, 8))


def test_few_cells_find_most_and_read_less(spark):
    chunks, queries = tables(spark, n=4000)
    want = answers(retrieval.search(chunks, queries, 10))
    got = answers(near_search.near_search(chunks, queries, 10, cells=20, probes=3, exact=False))
    pairs = {(key, c) for key, rows in want.items() if key[0].startswith("r") for _, c, _ in rows}
    found = {(key, c) for key, rows in got.items() for _, c, _ in rows}
    assert len(pairs & found) >= 0.9 * len(pairs)
    # A sample that saw nothing of most chunks still loses none.
    assert answers(near_search.near_search(chunks, queries, 10, cells=4, probes=1, sample=5)) == want


def test_no_chunks(spark):
    chunks, queries = tables(spark)
    assert near_search.near_search(chunks.limit(0), queries, 3).count() == 0
    assert near_search.near_search(chunks, queries.limit(0), 3).count() == 0
