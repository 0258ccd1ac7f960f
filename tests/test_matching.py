"""Project matching against literal values and subset enumeration."""

import itertools
import random
from difflib import SequenceMatcher

from worklens.operators import matching

PROJECT = "item_id string, project_reference string, project_title string, state string, created_date string"


def test_golden_match(spark):
    projects = spark.createDataFrame(
        [
            ("900001", "16771", "100 New Kings Road", "active", "2025-02-10"),
            ("900002", "20442", "New Kings Road Apartments", "active", "2024-11-18"),
            ("900003", "archived-perfect-match", "100 New Kings Road SW6 4LX", "archived", None),
        ],
        PROJECT,
    )
    enquiries = spark.createDataFrame([("e", "100 New Kings Road SW6 4LX")], "enquiry_id string, project_name string")
    counts = spark.createDataFrame([("Kings", 2), ("New", 12), ("Road", 8)], "word string, hits int")
    ranked = matching.rank_candidates(matching.match_projects(enquiries, projects, counts=counts))
    rows = ranked.orderBy("rank").collect()
    assert [(r.item_id, r.similarity, r.match_percentage) for r in rows] == [
        ("900001", 0.8181818181818182, "81.8%"),
        ("900002", 0.6274509803921569, "62.7%"),
    ]
    contract = matching.match_contracts(enquiries, ranked).first()
    assert (contract.exists, contract.match_type, contract.candidate_count) == (True, "existing", 2)
    assert contract.best_match.item_id == "900001" and contract.similarity_score == 0.8181818181818182
    companies = spark.createDataFrame([("e", ': "Roofs"')], "enquiry_id string, company string")
    report = matching.match_report(matching.match_contracts(enquiries, ranked), ranked, companies).collect()
    assert {r.extracted_company for r in report} == {"Roofs"} and len(report) == 2


def ratio(a, b):
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def enumerate_subsets(name, projects):
    """The search by trying subsets from the largest on, in order of hit counts."""
    live = [p for p in projects if p[3] == "active" and p[4] >= "2021-01-01"]
    words = [w for w in name.split() if len(w) > 2]
    if not words:
        return {p[0] for p in live if name.strip().lower() in p[2].lower()}
    hits = {w: min(50, sum(w.lower() in p[2].lower() for p in projects)) for w in words}
    ordered = sorted(words, key=hits.get)
    for size in range(len(ordered), 0, -1):
        for subset in itertools.combinations(ordered, size):
            found = {p[0] for p in live if all(w.lower() in p[2].lower() for w in subset)}
            if found:
                return found
    return {p[0] for p in live if max(ratio(name, p[1]), ratio(name, p[2])) >= 0.55}


def test_closed_form_equals_enumeration(spark):
    rng = random.Random(7)
    vocabulary = ["road", "kings", "new", "house", "wharf", "mill", "roadside", "xyzzy", "bridge"]
    projects = [
        (
            str(i),
            f"TP{i}",
            " ".join(rng.choices(vocabulary[:7], k=rng.randint(1, 4))).title(),
            rng.choice(["active", "active", "archived"]),
            rng.choice(["2020-12-31", "2023-01-01"]),
        )
        for i in range(60)
    ]
    names = {f"e{i}": " ".join(rng.choices(vocabulary, k=rng.randint(1, 5))) for i in range(80)}
    names.update({"none": "12", "typo": "Kigns Roda Mlil", "short": "ro", "double": "Road road Kings"})
    enquiries = spark.createDataFrame(list(names.items()), "enquiry_id string, project_name string")
    rows = matching.match_projects(enquiries, spark.createDataFrame(projects, PROJECT)).collect()
    for key, name in names.items():
        got = [r.item_id for r in rows if r.enquiry_id == key]
        assert len(got) == len(set(got))
        assert set(got) == enumerate_subsets(name, projects), name
    by_id = {p[0]: p for p in projects}
    for r in rows:
        p = by_id[r.item_id]
        assert r.similarity == max(ratio(r.project_name, p[1]), ratio(r.project_name, p[2]))


def test_containment_join_equals_brute_force(spark):
    rng = random.Random(9)
    texts = {"".join(rng.choices("abcé ", k=rng.randint(1, 12))) for _ in range(150)}
    terms = {"".join(rng.choices("abcé", k=rng.randint(1, 5))) for _ in range(80)} | {"zz"}
    df = matching.contains_join(
        spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(t,) for t in texts], "text string"), "term", "text"
    )
    got = sorted((r.term, r.text) for r in df.collect())
    assert got == sorted((a, b) for a in terms for b in texts if a in b)


def test_similarity_prefilter_misses_nothing(spark):
    rng = random.Random(2)
    names = {"".join(rng.choices("abcdefgh ", k=rng.randint(1, 14))) for _ in range(60)}
    texts = {"".join(rng.choices("abcdefgh ", k=rng.randint(1, 14))) for _ in range(90)}
    for threshold in (0.55, 0.8):
        df = matching.similar_texts(
            spark.createDataFrame([(t,) for t in names], "name string"), spark.createDataFrame([(t,) for t in texts], "text string"), threshold
        )
        rows = [(r.name, r.text) for r in df.collect()]
        assert len(rows) == len(set(rows))
        assert {(a, b) for a in names for b in texts if ratio(a, b) >= threshold} <= set(rows)


def counted(monkeypatch, prefix):
    """Rows of the intermediate tables with the name, as they are written."""
    rows, write = [], matching.written

    def note(df, name):
        made = write(df, name)
        if name == prefix:
            rows.append(made.count())
        return made

    monkeypatch.setattr(matching, "written", note)
    return rows


def test_pairs_keep_a_common_word_from_meeting_everything(spark, monkeypatch):
    """One word is in a third of the titles: join rows stay below ten times the result."""
    rng = random.Random(11)
    rare = [f"{a}{b}" for a in ("mill", "wharf", "abbey", "crown", "park") for b in ("side", "view", "gate", "ham", "ley", "ton")]
    titles = {f"{'road ' if i % 3 == 0 else ''}{' '.join(rng.sample(rare, 3))} x{i}" for i in range(900)}
    projects = [(str(i), f"TP{i}", t, "active", "2023-01-01") for i, t in enumerate(sorted(titles))]
    names = {f"e{i}": f"{' '.join(rng.sample(rare, 2))} road" for i in range(120)}
    rows = counted(monkeypatch, "pair-candidates")
    monkeypatch.setattr(matching, "HOT_ROWS", 20)
    enquiries = spark.createDataFrame(list(names.items()), "enquiry_id string, project_name string")
    got = matching.match_projects(enquiries, spark.createDataFrame(projects, PROJECT)).select("enquiry_id", "item_id").collect()
    for key, name in list(names.items())[:40]:
        assert {r.item_id for r in got if r.enquiry_id == key} == enumerate_subsets(name, projects), name
    with_road = sum("road" in t for t in titles)
    assert sum(rows) < 10 * len(got) and sum(rows) < len(names) * with_road / 10


def test_word_sets_equal_brute_force(spark):
    """Repeated words, lists that share nothing, ties of size, and sets of every size."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(9)]
    lists = [tuple(rng.choices(words, k=rng.randint(1, 6))) for _ in range(80)] + [("q", "q"), ("w1", "w1", "q")]
    sets = {tuple(sorted(rng.sample(words, rng.randint(1, 5)))) for _ in range(40)}
    df = matching.best_word_sets(
        spark.createDataFrame([(list(x),) for x in lists], "_list array<string>"), spark.createDataFrame([(list(x),) for x in sets], "_set array<string>")
    )
    want = set()
    for words_of in set(lists):
        found = {s: tuple(i for i, w in enumerate(words_of) if w in s) for s in sets}
        several = [f for f in found.values() if len(f) > 1]
        if several:
            best = min(several, key=lambda f: (-len(f), f))
            want |= {(words_of, s, best) for s, f in found.items() if f == best}
    assert {(tuple(r._list), tuple(r._set), tuple(r._found)) for r in df.collect()} == want


def test_similar_names_leave_the_join_only_where_they_can_qualify(spark, monkeypatch):
    """Candidate rows against the pairs whose common characters suffice; a hot token is dealt to several tasks."""
    rng = random.Random(3)
    names = {"".join(rng.choices("eeeatrsn ", k=rng.randint(4, 30))) for _ in range(60)}
    texts = {"".join(rng.choices("eeeatrsnolu ", k=rng.randint(4, 40))) for _ in range(400)}
    monkeypatch.setattr(matching, "HOT_ROWS", 50)
    left = spark.createDataFrame([(t,) for t in names], "name string")
    right = spark.createDataFrame([(t,) for t in texts], "text string")

    def common(a, b):
        return sum(min(a.count(c), b.count(c)) for c in set(a))

    for threshold in (0.55, 0.8):
        rows = [(r.name, r.text) for r in matching.similar_texts(left, right, threshold).collect()]
        able = {(a, b) for a in names for b in texts if 2 * common(a, b) >= threshold * (len(a) + len(b))}
        assert len(rows) == len(set(rows)) and set(rows) == able
        assert matching.similar_candidates(left, right, threshold).count() <= 1.5 * len(able) + 20


def test_ratios_are_worked_out_once_behind_the_repartition(spark):
    """The filter on the ratio must not move it in front of the exchange that spreads the pairs, nor repeat it."""
    enquiries = spark.createDataFrame([("e", "Harbour Bridge")], "enquiry_id string, project_name string")
    row = ("1", "TP1", "Harbour Bridge West", "active", "2023-01-01")
    projects = spark.createDataFrame([row], "item_id string, project_reference string, project_title string, state string, created_date string")
    matches = matching.match_projects(enquiries, projects)
    for shown in (matches, matches.select("item_id")):
        plan = shown._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1
        assert plan.index("ArrowEvalPython") < plan.index("RepartitionByExpression")


def test_best_of_two_equals_both_ratios():
    from difflib import SequenceMatcher

    from worklens.functions.words import _best_of_two

    def plain(name, reference, title):
        ratios = [SequenceMatcher(None, name.lower(), x.lower()).ratio() for x in ([title] if title else []) + ([reference] if reference is not None else [])]
        return max([0.0, *ratios]) if name is not None else 0.0

    texts = ["", "a", "TP12", "Old Mill Road 12", "old mill", "Mill Road", "Brücke İstanbul", "harbour bridge", None]
    for name in texts:
        for reference in texts:
            for title in texts:
                assert _best_of_two(name, reference, title) == (0.0 if name is None else plain(name, reference, title))
