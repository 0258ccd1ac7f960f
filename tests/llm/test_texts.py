"""Near-duplicates, benchmark leaks, both classifiers and the language model on small tables."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import worklens.llm.language_crf as crf
from worklens.llm import decontamination as leaks
from worklens.llm import pitman_yor as lm
from worklens.llm import quality
from worklens.llm.blobs import pack_counts, pack_keys, unpack_counts
from worklens.llm.common import mixed
from worklens.llm.components import components
from worklens.llm.jaccard_join import jaccard_components, one_of_each

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def linked_by_hand(rows, width=5):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    lowest = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        if i is not None:
            lowest[r] = min(lowest.get(r, i), i)
    return sorted(((i, len(sets[k]), lowest.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def near_copies(seed, groups):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 60, 120]))]
        for _ in range(rng.choice([1, 2, 6, 25])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                at = rng.randrange(len(text))
                text[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)]
            rows.append((len(rows) + 1, " ".join(text)))
    common = " ".join(rng.choice(vocabulary) for _ in range(50))
    for _ in range(30):
        rows.append((len(rows) + 1, " ".join([common, *(rng.choice(vocabulary) for _ in range(rng.randint(5, 14)))])))
    rng.shuffle(rows)
    return rows


def test_components_by_jaccard_equal_brute_force(spark):
    rows = near_copies(4, 12)
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, "One"), (1004, "one"), (1005, "a b c d"), (1006, "A B c D"), (1006, "A B c D")]
    rows += [(None, "one"), (None, "alone here"), (1010, "x " * 30000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string").repartition(7)
    got = sorted((tuple(r) for r in jaccard_components(df).collect()), key=str)
    assert got == linked_by_hand(rows)


def test_without_pivots_the_filters_alone_find_the_same(spark):
    rows = near_copies(5, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in jaccard_components(df, pivot_rounds=0).collect()), key=str)
    assert got == linked_by_hand(rows)


def test_one_document_of_each_group_stays(spark):
    rows = [(3, "a b c d e f", 1), (2, "A b c d e f", 1), (5, "other text", 1), (5, "other text", 2), (None, "no id", 1), (7, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "5", "7", "None"]
    assert one_of_each(df.limit(0)).count() == 0
    assert jaccard_components(df.limit(0)).count() == 0


def test_rows_stay_by_component_and_not_by_id(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(40)) for _ in range(6)]
    near = texts[1] + " end"
    rows = [(1, texts[0], 1), (1, texts[1], 2), (1, texts[2], 3), (1, texts[2], 4)]  # an id of three documents
    rows += [(9, texts[3], 5), (9, near, 6), (9, texts[3] + " end", 7)]  # one new, one linked to id 1
    rows += [(None, texts[4], k) for k in range(10, 15)] + [(None, texts[5], 20), (30, texts[5] + " end", 21)]
    rows += [(None, None, 40), (None, " ", 41), (50, None, 42), (50, None, 43)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(5)
    kept = [r["n"] for r in one_of_each(df).collect()]
    want = [{1}, {2}, {3, 4}, {5, 7}, set(range(10, 15)), {21}, {40}, {41}, {42}, {43}]
    assert len(kept) == len(want) and all(len(w & set(kept)) == 1 for w in want)


def test_components_of_a_block_of_many_short_texts(spark):
    rows = [(i, f"w{i}") for i in range(66000)] + [(70000, " ".join(map(str, range(30)))), (70001, " ".join(map(str, range(31))))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "0")
    try:
        moved = {r["doc_id"]: r["component_id"] for r in jaccard_components(df).filter("doc_id <> component_id").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert moved == {70001: 70000}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(200, 200), (301, 300), (300, 301)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)} | {300: 300, 301: 300}
    assert got == want


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance_equals_the_matrix():
    rng = random.Random(1)
    for _ in range(500):
        pattern = "".join(rng.choice("ab") for _ in range(rng.randint(1, 80)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))
        assert leaks.substring_distance(pattern, text)[0] == distance(pattern, text)
        d, start, end = leaks.located(pattern, text)
        assert distance(pattern, text[start:end]) == d


def test_pieces_lose_no_occurrence():
    rng = random.Random(2)
    item = "abcabdabbacdab"
    index = leaks.PieceIndex([(0, item)], 1 / 4)
    for _ in range(2000):
        text = "".join(rng.choice("abcd") for _ in range(30))
        assert bool(index.find(text)) == (distance(item, text) <= len(item) // 4)


def test_benchmark_hits_and_clean_documents(spark):
    item = "The quick brown fox jumps over the lazy dog near the quiet river bank at dawn today."
    typo = item.replace("brown", "brwn").replace("lazy", "lazzy").upper()
    rows = [(1, f"x\n{item} y"), (2, f"a {typo} b"), (3, "clean text"), (4, None), (5, ""), (1, f"x\n{item} y"), (6, f"{item} and {item}"), (7, "z " * 50000 + item), (8, "The quick brown fox")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string")
    items = spark.createDataFrame([("q", item), ("n", None), ("b", " "), ("q2", item)], "item_id string, text string")
    got = leaks.benchmark_hits(docs, items, batch_bytes=100).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(d, q) for d in (1, 2, 6, 7) for q in ("q", "q2")}
    found = {r["doc_id"]: r for r in got if r["item_id"] == "q"}
    assert (found[1]["start"], found[1]["end"], found[1]["distance"]) == (2, 2 + len(item), 0)
    assert found[2]["distance"] == 2
    assert sum(r["doc_id"] == 6 for r in got) == 4 and sum(r["doc_id"] == 1 for r in got) == 4
    kept = leaks.decontaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 8]
    assert leaks.benchmark_hits(docs, items.limit(0)).count() == 0
    assert leaks.benchmark_hits(docs.limit(0), items).count() == 0
    assert leaks.decontaminated(docs, items.limit(0)).count() == len(rows)


def test_forward_backward_equals_enumeration(monkeypatch):
    rng = np.random.default_rng(0)
    emissions, moves = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    want, pairs, whole = np.zeros((7, 3)), np.zeros((3, 3)), 0.0
    for path in itertools.product(range(3), repeat=8):
        weight = math.exp(sum(moves[path[i], path[i + 1]] + emissions[i, path[i + 1]] for i in range(7)))
        whole += weight
        for i in range(7):
            want[i, path[i + 1]] += weight
            pairs[path[i], path[i + 1]] += weight
    for block in (2, 3, 32):
        monkeypatch.setattr(crf, "BLOCK", block)
        got, expected = crf.marginals(np.concatenate([emissions, emissions[:2]]), np.array([0, 0, 7, 7, 9]), moves)
        assert np.allclose(got[:7], want / whole)
        alone, one = crf.marginals(emissions, np.array([0, 7]), moves)
        assert np.allclose(one, pairs / whole) and np.allclose(alone, got[:7])


EN = "the house and the garden with some trees stand there while people walk home"
DE = "das haus und der garten mit einigen bäumen stehen dort während leute heimgehen"


def language_docs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        base = (EN if i % 2 else DE).split()
        rows.append((i, " ".join(rng.choice(base) for _ in range(30)), "en" if i % 2 else "de", "x"))
    rows += [(100, None, "en", "x"), (101, "", "de", "x"), (102, "12 !! 34", "en", "x"), (103, "the house " * 20000, None, "x"), (1, rows[1][1], "en", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), rows


def test_language_of_documents_and_words(spark):
    docs, rows = language_docs(spark)
    model = crf.fit(docs, F.col("doc_id") < 40)
    got = crf.with_language(docs, model).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == lang for i, _, lang, _ in rows if 40 <= i < 60)
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (100, 101, 102))
    assert by_id[103]["lang_pred"] == "en" and 0.5 < by_id[103]["score"] <= 1
    switched = model.word_labels(f"{EN} {DE} 42")
    assert sum(lang == "en" for _, lang, _ in switched[: len(EN.split())]) > 10
    assert sum(lang == "de" for _, lang, _ in switched[len(EN.split()) :]) > 9 and switched[-1][1] == "und"
    none = crf.fit(docs, F.lit(False))
    assert none is None and {r["lang_pred"] for r in crf.with_language(docs, none).collect()} == {"und"}
    assert crf.with_language(docs.limit(0), model).count() == 0


def test_quality_is_learned_and_short_texts_stay_near_the_base(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(120):
        ws = [rng.choice(EN.split()) for _ in range(25)]
        bad = i % 4 == 0
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in ws), "x"))
        labels.append((i, 0 if bad else 1, "x"))
    rows += [(500, None, "x"), (501, "", "x"), (502, "word " * 30000, "x"), (3, rows[3][1], "x")]
    labels += [(999, 1, "x"), (None, 0, "x"), (7, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, text string")
    model = quality.fit(docs, marks, F.col("doc_id") < 80)
    got = {r["doc_id"]: r["score"] for r in quality.with_quality(docs, model).collect()}
    assert all((got[i] >= 0.3) == (i % 4 != 0) for i in range(80, 120))
    assert all(0 <= s <= 1 for s in got.values()) and got[500] == got[501]
    assert quality.fit(docs, marks.limit(0), F.lit(True)) is None
    assert {r["score"] for r in quality.with_quality(docs, None).collect()} == {0.5}
    assert quality.with_quality(docs.limit(0), model).count() == 0


def test_dual_coordinate_descent_reaches_the_primal_optimum():
    rng = np.random.default_rng(3)
    n, dims = 60, 8
    x = rng.normal(size=(n, dims))
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=n) > 0, 1, -1)
    features, values = [np.arange(dims)] * n, list(x)
    w, bias = quality.dual_coordinate_descent(features, values, y, np.full(n, 0.7), epochs=3000)

    def primal(v):
        margin = y * (x @ v[:-1] + v[-1])
        return 0.5 * v @ v + 0.7 * np.maximum(0, 1 - margin).sum()

    best = np.append(w[:dims], bias)
    at = primal(best)
    assert all(primal(best + 0.01 * rng.normal(size=dims + 1)) >= at - 1e-6 for _ in range(300))


def lm_table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, train boolean, score string")


def test_language_model_without_repeated_pairs_is_the_closed_form(spark):
    rows = [(1, "a b c", True), (2, "b D", True), (3, "a zzz", False), (4, None, False), (5, " ", None)]
    got = {r["doc_id"]: r for r in lm.score_documents(lm_table(spark, rows), F.col("train")).collect()}
    texts = {i: [*words(t), "\n"] for i, t, _ in rows}
    train = [texts[1], texts[2]]
    count, pairs = {}, {}
    for t in train:
        for u, v in zip(["\n", *t], t):
            count[v] = count.get(v, 0) + 1
            pairs[u, v] = pairs.get((u, v), 0) + 1
    assert max(pairs.values()) == 1
    n, v = sum(count.values()), len(count)
    followers, parents = {}, {}
    for a, b in pairs:
        followers[a] = followers.get(a, 0) + 1
        parents[b] = parents.get(b, 0) + 1
    d = lm.discount(len(pairs), 0)
    for i, t in texts.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in count for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in t))
    # Parents with two customers are seated at random: check the pairs of words with one.
    whole = sum(parents.values())
    assert whole == len(pairs) and d == 0.95
    assert all(r["score"] < 0 for r in got.values()) and got[4]["score"] == got[5]["score"]


def test_probabilities_of_all_continuations_sum_to_one(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(6)]
    rows = [(i, " ".join(rng.choice(vocabulary[: 2 + i % 5]) for _ in range(20)), True) for i in range(60)]
    names = [*{w for _, t, _ in rows for w in t.split()}, "unseen"]
    singles = [(1000 + i, w, False) for i, w in enumerate(names)]
    doubles = [(2000 + i, f"{u} {w}", False) for i, (u, w) in enumerate(itertools.product(names, names))]
    probes = [(900, "", False), *singles, *doubles]
    got = {r["doc_id"]: 10 ** r["score"] for r in lm.score_documents(lm_table(spark, rows + probes), F.col("train")).collect()}
    single = np.array([got[i] for i, _, _ in singles])
    double = np.array([got[i] for i, _, _ in doubles]).reshape(len(names), -1)
    # With x = 1 / P(end | w): the continuations of every w sum to one where x = 1 + (double / single) x.
    x = np.linalg.solve(np.eye(len(names)) - double / single[:, None], np.ones(len(names)))
    assert (x > 1).all()
    # Then the first words, single * x, and the empty text must sum to one as well.
    assert (single * x).sum() + got[900] == pytest.approx(1.0, abs=1e-6)


def test_seating_follows_the_restaurant_and_the_sampler_its_target():
    rng = np.random.default_rng(1)
    c, d, strength = 37, 0.6, 0.3
    chance = {1: 1.0}
    for i in range(1, c):
        new = {}
        for t, p in chance.items():
            q = (strength + d * t) / (strength + i)
            new[t + 1] = new.get(t + 1, 0) + p * q
            new[t] = new.get(t, 0) + p * (1 - q)
        chance = new
    drawn = lm.tables_drawn(rng, np.full(100000, c), d, np.full(100000, strength))
    assert max(abs(p - (drawn == t).mean()) for t, p in chance.items()) < 0.01
    stirling = np.zeros((c + 2, c + 2))
    stirling[1, 1] = 1
    for n in range(1, c):
        for t in range(1, n + 1):
            stirling[n + 1, t] += stirling[n, t] * (n - d * t)
            stirling[n + 1, t + 1] += stirling[n, t]
    c, others, base, theta = 20, 5, 0.05, 1.0
    target = np.array([stirling[c, t] * np.prod([base * (theta + d * (others + j)) for j in range(t)]) for t in range(1, c + 1)])
    target /= target.sum()
    tables = np.ones(50000, dtype=int)
    for _ in range(25):
        tables = lm.reseated(rng, np.full(50000, c), tables, d, theta, np.full(50000, others), np.full(50000, base))
    assert max(abs(target[k - 1] - (tables == k).mean()) for k in range(1, c + 1)) < 0.01
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    assert (lm.unmixed(mixed(x)) == x).all()


def test_counts_beyond_four_bytes_stay_whole():
    for values in ([], [0, 0], [255, 256, 3], [2**32 - 1, 2**32, 7], [2**40 + 5, 1], [2**62]):
        assert unpack_counts(pack_counts(np.array(values, dtype=np.int64))).tolist() == values
    word = np.array([5 << 24, 9 << 24], dtype=np.uint64)
    rows = [lm.row("words", 0, block, a=pack_keys(word), b=pack_counts(np.array([3 << 30, 1]))) for block in (1, 2)]
    vocabulary, *asked = lm._word_counts(lm.table_of(rows)).to_pylist()
    assert vocabulary["totals"] == [(3 << 31) + 2, 2]
    assert unpack_counts(vocabulary["b"]).tolist() == [3 << 31, 2]
    assert [unpack_counts(r["b"]).tolist() for r in asked] == [[3 << 31, 2]] * 2


def test_language_model_of_hot_words_long_texts_and_nothing(spark):
    rows = [(i, "hot hot " * 50, True) for i in range(50)] + [(60, "hot " * 40000, True), (61, "hot cold", False), (61, "hot cold", False), (None, "x", True)]
    got = lm.score_documents(lm_table(spark, rows), F.col("train")).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[60]["n_tokens"] == 40001 and by_id[60]["score"] / 40001 > -0.1
    assert by_id[61]["n_known"] == 2 and by_id[61]["n_tokens"] == 3
    assert lm.score_documents(lm_table(spark, rows).limit(0), F.col("train")).count() == 0
    none = lm.score_documents(lm_table(spark, rows[:2]), F.lit(False)).first()
    assert none["train_tokens"] == 0 and none["n_known"] == 0 and none["base_score"] == 0.0
