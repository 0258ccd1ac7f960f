"""URL filters, sharding, packing, vector search and token totals on small tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from worklens.llm import packing, queries, sharding, token_rollup, url_filter, vector_search
from worklens.llm.url_filter import DigestIndex

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def plain_verdict(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


URLS = [
    None, "", "no scheme", "http://", "https://A.Example.NET/en/x?y#z", "http://example.net", "http://net/", "http://xnet/", "ftp://b.org/fr/1",
    "http://b.org/fr", "http://example.com/de/?a", "http://m.example.com/DE/", "http://example.com?/de/", "x://a://b.net/", "http://.net/", "http://net./",
    "http://" + "a." * 300 + "net/" + "p" * 3000,
]


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_url_verdicts_equal_a_plain_version(spark, broadcast_bytes):
    rows = [(i, u, "old") for i, u in enumerate(URLS + URLS[:5])]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), RULES[0]], "host string, path string, verdict string")
    got = url_filter.url_verdicts(pages, rules, broadcast_bytes=broadcast_bytes).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_verdict(r["url"], RULES), r["url"]


def test_url_filter_without_rules_or_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.url_verdicts(pages, none).collect()] == ["allow"]
    assert url_filter.url_verdicts(pages.limit(0), none).count() == 0


def test_digest_collisions_are_told_apart_by_their_strings():
    index = DigestIndex(RULES, digest=lambda key: len(key) % 2)
    keys = [f"{h}\0{p}".encode() for h, p, _ in RULES]
    assert [index.rule(int(e)) for e in index.find(keys)] == [h + p for h, p, _ in RULES]
    assert index.find([b"x\0/", b"nets\0/"]).tolist() == [-1, -1]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 17, 99, 100, 101, 1000])
def test_permutation_is_a_bijection_and_the_columns_follow_it(spark, n):
    want = [sharding.permuted(i, n, 7) for i in range(n)]
    assert sorted(want) == list(range(n))
    got = sharding.with_permuted(spark.range(n), "id", n, 7).orderBy("id").collect()
    assert [r["position"] for r in got] == want


def test_shards_are_even_gapless_and_reproducible(spark):
    texts = [None, "", "x", "ü" * 5, "long " * 40000, "x", "x"]
    rows = [(i if i % 9 else None, texts[i % 7], i) for i in range(500)] + [(4, "x", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int")
    one = sharding.shard_documents(docs.repartition(5), 7, 3).collect()
    two = sharding.shard_documents(docs.repartition(2), 7, 3).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))
    by_shard = {}
    for r in one:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
        assert sharding.permuted(r["row_number"], len(rows), 3) == r["slot"] * 7 + r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in one) == want
    assert sharding.shard_documents(docs.limit(0), 7).count() == 0


def best_by_hand(rows, queries, k):
    def good(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v)

    out = set()
    for q, v in dict((q, v) for q, v in queries if good(v)).items():
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(v, w)), i) for i, w in rows if i != q and good(w) and len(w) == len(v))
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("scale", [5, 300, 2**40])
def test_top_k_equals_brute_force(spark, scale):
    rng = random.Random(scale)
    rows = [(i, [float(rng.randint(-scale, scale)) for _ in range(20)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]
    rows += [(300, None), (301, [1.0, None] * 10), (302, [float("nan")] * 20), (303, [float("inf")] * 20), (304, [1.0, 2.0]), (305, [3.0, 4.0]), (306, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    asked = [r for r in rows if r[0] % 5 == 0]
    got = vector_search.top_k(df, df.filter("vec_id % 5 = 0"), 4, candidate_rows=37, query_rows=11).collect()
    wanted = best_by_hand(rows, asked, 4)
    if scale < 2**40:
        assert {tuple(r) for r in got} == wanted
    else:  # scores beyond a long stop at its ends; ranks among them go by id
        assert len(got) == len(wanted)


def test_top_k_of_empty_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_search.top_k(empty, empty).count() == 0


def test_best_fit_fills_opens_and_shrinks():
    bins, offsets, sizes = packing.best_fit([700, 300, 500, 24, 1], [512, 1024])
    assert sum(sizes) == 1536 and len(sizes) == 2
    assert bins[0] == bins[1] == bins[3] and bins[2] != bins[0]
    assert packing.best_fit([], [512]) == ([], [], [])
    assert packing.best_fit([10], [8192, 64, 16])[2] == [16]


def test_every_token_is_packed_once_without_overlap(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(0, 300)), "x") for i in range(300)] + [(7, "a b", "x")] * 4 + [(None, None, "x"), (900, "", "x"), (901, "v " * 5000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bin string")
    got = packing.pack(docs, (64, 128, 256), group_pieces=100).collect()
    want = sum(len((t or "").split()) + 1 for _, t, _ in rows)
    assert sum(r["length"] for r in got) == want
    bins = {}
    for r in got:
        assert 0 < r["length"] <= 256 and r["capacity"] in (64, 128, 256)
        bins.setdefault((r["pack_group"], r["bin"]), []).append((r["bin_offset"], r["length"], r["capacity"]))
    for parts in bins.values():
        parts.sort()
        assert all(a + n <= b for (a, n, _), (b, _, _) in zip(parts, parts[1:]))
        filled = parts[-1][0] + parts[-1][1]
        assert parts[0][2] == min(c for c in (64, 128, 256) if c >= filled)
    pieces = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == 901)
    assert pieces[0] == (0, 256) and sum(n for _, n in pieces) == 5001
    assert sum(len(p) and p[0][2] for p in bins.values()) < 1.25 * want
    assert packing.pack(docs.limit(0)).count() == 0


def test_rollup_is_additive_and_idempotent(spark, tmp_path):
    path = str(tmp_path / "rollup")
    rows = [(1, "a b c", "en", "s1"), (2, "a, b", None, "s1"), (3, None, "de", None), (4, "", "en", "s1"), (4, "", "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("docs", F.lit("x"))
    v1, v2 = token_rollup.words_v1(F.col("text")), token_rollup.words_v2(F.col("text"))
    token_rollup.commit("2", token_rollup.revised(docs.filter("doc_id = 2"), ("v1", v1), ("v2", v2)), path)
    token_rollup.commit("1", token_rollup.inserted(docs, "v1", v1), path)
    token_rollup.commit("3", token_rollup.deleted(docs.filter("doc_id = 3"), "v1", v1), path)
    token_rollup.commit("4", token_rollup.inserted(docs.limit(0), "v1", v1), path)
    want = {("s1", "en", "v1", 3, 3), ("s1", None, "v2", 1, 3)}
    assert {tuple(r) for r in token_rollup.totals(spark, path).collect()} == want
    token_rollup.commit("1", token_rollup.inserted(docs, "v1", v1), path)
    token_rollup.commit("2", token_rollup.revised(docs.filter("doc_id = 2"), ("v1", v1), ("v2", v2)), path)
    assert {tuple(r) for r in token_rollup.totals(spark, path).collect()} == want
    with pytest.raises(ValueError):
        token_rollup.commit("a/b", token_rollup.inserted(docs, "v1", v1), path)


def test_rollup_query_equals_its_sql_with_null_and_repeated_ids(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(None, "only one here", "en", "a"), (None, "ja, so", "de", "a"), (None, "ja, so", "fr", "b"), (4, "ja, so", "de", "c")]
    rows += [(1, "a, b", "de", "a")] * 3 + [(2, "a, b", "de", "b"), (2, "c d e", "de", "b"), (1, "c d e", "fr", "c")]
    rows += [(None, None, "de", "n"), (7, None, "de", "n"), (None, "twice", "de", "t"), (None, "twice", "de", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    build, sql = queries.REGISTRY["op6_token_rollup"]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(sql).fetchall(), key=str)
    assert sorted((tuple(r) for r in build(spark, str(tmp_path)).collect()), key=str) == want


def test_bpe_counts_equal_the_tokenizer(spark):
    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("public_tokenizers")
    import base64

    path = tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encoding = tiktoken.Encoding("t", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello  world", None, "", "naïve <|endoftext|>"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, tokens string")
    got = {r["doc_id"]: r["tokens"] for r in token_rollup.bpe_counts(docs, path).collect()}
    assert got == {i: len(encoding.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}


def quadratic_best_fit(sizes, capacities, cost):
    """Best fit by looking at every open bin for every piece."""
    bins, place, left = [], {}, sum(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        rooms = [(free - sizes[i], b) for b, (free, _) in enumerate(bins) if free >= sizes[i]]
        if rooms:
            b = min(rooms)[1]
        else:
            b = len(bins)
            bins.append((min((c for c in capacities if c >= sizes[i]), key=lambda c: (cost(c) / max(1, min(c, left)), c)), []))
        place[i] = (b, sum(sizes[k] for k in bins[b][1]))
        bins[b] = (bins[b][0] - sizes[i], [*bins[b][1], i])
        left -= sizes[i]
    return place, [min(c for c in capacities if c >= sum(sizes[k] for k in members)) for _, members in bins]


def cheapest(sizes, capacities, cost):
    """The least cost of all ways to deal the pieces to bins."""

    def rest(k, loads):
        if k == len(sizes):
            return sum(cost(min(c for c in capacities if c >= load)) for load in loads)
        options = [rest(k + 1, [*loads[:b], loads[b] + sizes[k], *loads[b + 1 :]]) for b in range(len(loads)) if loads[b] + sizes[k] <= max(capacities)]
        return min([*options, rest(k + 1, [*loads, sizes[k]])])

    return rest(0, [])


def test_packing_equals_plain_best_fit_and_stays_near_the_optimum():
    rng = random.Random(13)
    for _ in range(300):
        capacities = sorted(rng.sample([8, 16, 32, 64, 128], rng.randint(1, 4)))
        sizes = [rng.choice([1, 3, rng.randint(1, capacities[-1])]) for _ in range(rng.randint(0, 40))]
        bins, offsets, held = packing.best_fit(sizes, capacities)
        place, want = quadratic_best_fit(sizes, capacities, packing.sequence_cost)
        assert ([place[i] for i in range(len(sizes))], want) == (list(zip(bins, offsets)), held)
    for _ in range(40):
        capacities = sorted(rng.sample([8, 16, 32], 2))
        sizes = [rng.randint(1, capacities[-1]) for _ in range(rng.randint(1, 7))]
        own = sum(packing.sequence_cost(c) for c in packing.best_fit(sizes, capacities)[2])
        least = cheapest(sizes, capacities, packing.sequence_cost)
        assert least <= own + 1e-9 and own <= 1.5 * least


def test_packed_documents_equal_plain_best_fit(spark):
    """One group: null and repeated ids, ties of length, and documents longer than every bin."""
    rng = random.Random(14)
    rows = [(rng.choice([None, 1, 2, 3, 40]), rng.choice([5, 5, 30, 64, 200, 0])) for _ in range(120)]
    docs = spark.createDataFrame([(i, "w " * (n - 1) if n else None) for i, n in rows], "doc_id long, text string").coalesce(1)
    got = packing.pack(docs, (16, 64, 128), group_pieces=10_000).collect()
    pieces = []
    for i, n in rows:
        n = max(1, n)
        pieces += [(i, p, min(128, n - 128 * p)) for p in range(-(-n // 128))]
    pieces.sort(key=lambda p: (p[0] is None, p[0] or 0, p[1]))
    want = {}
    # Rows of one id are taken as they come, so only what the bins hold is compared.
    place, held = quadratic_best_fit(sorted((p[2] for p in pieces), reverse=True), (16, 64, 128), packing.sequence_cost)
    assert sorted(r["capacity"] for r in {r["bin"]: r for r in got}.values()) == sorted(held)
    assert sorted((str(r["doc_id"]), r["piece"], r["length"]) for r in got) == sorted((str(i), p, n) for i, p, n in pieces)
    for r in got:
        want.setdefault(r["bin"], []).append((r["bin_offset"], r["length"]))
    for members in want.values():
        members.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(members, members[1:])) and members[0][0] == 0


def test_a_url_of_a_megabyte_is_judged_by_its_few_last_labels(spark):
    hosts = ["a." * 500_000 + "example.com", "x" * 1_000_000, "b." * 1000 + "net", "notexample.com", "example.com", "deep.er.example.com"]
    pages = spark.createDataFrame([(i, f"http://{h}/de/x") for i, h in enumerate(hosts)], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    want = {0: "example.com/de/", 1: None, 2: "net/", 3: None, 4: "example.com/de/", 5: "example.com/de/"}
    for size in (64 << 20, 0):
        got = url_filter.url_verdicts(pages, rules, broadcast_bytes=size).select("page_id", "rule").collect()
        assert {r["page_id"]: r["rule"] for r in got} == want
    assert list(url_filter.candidates("a.b.c", "/", [1], 3)) == [("b.c", "/"), ("c", "/")]
    assert list(url_filter.candidates("ab.c", "/", [1], 3)) == [("c", "/")] and list(url_filter.candidates("abcd", "/", [1], 3)) == []
