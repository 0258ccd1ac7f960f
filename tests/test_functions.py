"""Column functions against literal values and plain Python."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from worklens import vocab
from worklens.functions import dates, keys, text, values, vectors, words


def one(spark, *columns, **fields):
    schema = ", ".join(f"{n} {t}" for n, (t, _) in fields.items()) or "x int"
    row = tuple(v for _, v in fields.values()) or (1,)
    return tuple(spark.createDataFrame([row], schema).select(*columns).first())


def windows(t, size, overlap):
    out, start = [], 0
    while start < len(t):
        end = min(len(t), start + size)
        out.append((start, end, t[start:end]))
        if end == len(t):
            break
        start = end - overlap
    return out


def test_chunks_equal_a_sliding_window(spark):
    rng = random.Random(3)
    sizes = [0, 1, 149, 150, 151, 849, 850, 851, 999, 1000, 1001, 1850, 1851, 2000, 2700, 2701, 5000]
    texts = ["".join(rng.choice("ab \n\U0001f600é\x00") for _ in range(n)) for n in sizes]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.chunks("t").alias("c")).collect()
    for row in rows:
        expected = windows(row.t.replace("\x00", "").strip(), 1000, 150)
        assert [(c.chunk_start, c.chunk_end, c.chunk_text) for c in row.c] == expected
        assert [c.chunk_index for c in row.c] == list(range(1, len(expected) + 1))
        assert {c.chunk_total for c in row.c} <= {len(expected)}


def test_chunk_limits_are_optional(spark):
    t = "x" * 500_000
    full, cut = one(
        spark,
        F.size(text.chunks("t")),
        F.size(text.chunks("t", max_chars=vocab.INGEST_MAX_CHARS, max_chunks=vocab.INGEST_MAX_CHUNKS)),
        t=("string", t),
    )
    assert full == len(windows(t, 1000, 150))
    assert cut == min(400, len(windows(t[:400_000], 1000, 150)))


@pytest.mark.parametrize("raw", ["  a \t b\x1f ", " x　y ", "", "plain", "\x85 "])
def test_strip_and_collapse_follow_python(spark, raw):
    got = one(spark, text.strip("t"), text.collapse("t"), text.rstrip("t"), t=("string", raw))
    assert got == (raw.strip(), " ".join(raw.split()), raw.rstrip())


def test_evidence_snippet_drops_the_disclaimer(spark):
    snippet = "Site postcode: HP1 2AB.\n\nDisclaimer\n\nThe information contained in this communication is confidential."
    shown = text.evidence_snippet("s", "a", "f")
    assert one(spark, shown, s=("string", snippet), a=("string", "email:body"), f=("string", "project.msg")) == ("Site postcode: HP1 2AB.",)
    assert one(spark, shown, s=("string", snippet), a=("string", "page:1"), f=("string", "plan.pdf")) == (snippet,)


def test_section_display(spark):
    pairs = {"email:body:chunk:3": "email:body", "chunk:3": "chunk:3", ":chunk:5": "", "row:1": "row:1", "a:chunk:x": "a:chunk:x"}
    for raw, shown in pairs.items():
        assert one(spark, text.display_section("t"), t=("string", raw)) == (shown,)


def test_input_revision_is_the_hash_of_ordered_records(spark):
    records = [("12", "2026-07-29T09:45:00Z", "Später \"x\".eml", 20), ("3", "2026-07-29T09:45:00Z", "Earlier.msg", 10)]
    df = spark.createDataFrame([(records,)], "a array<struct<asset_id string, created_at string, filename string, size long>>")
    ordered = [
        {"assetId": a, "createdAt": c, "filename": f, "size": s} for a, c, f, s in sorted(records, key=lambda r: (int(r[0]), r[2]))
    ]
    canonical = json.dumps(ordered, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()
    assert df.select(keys.input_revision("a")).first()[0] == hashlib.sha256(canonical).hexdigest()
    assert one(spark, keys.input_revision("a"), a=("array<struct<asset_id string, created_at string, filename string, size long>>", [])) == (None,)


def test_snapshot_version(spark):
    ids = keys.distinct_ids(F.col("a"), F.col("b"))
    got = one(spark, keys.snapshot_version("u", ids), a=("array<string>", ["9", "10", None]), b=("array<string>", ["9"]), u=("string", None))
    assert got == (hashlib.sha256(b":10,9").hexdigest(),)


def test_positive_ids(spark):
    cases = {"00012": "12", " 7 ": "7", "0": None, "-3": None, "x1": None, "": None}
    for raw, expected in cases.items():
        assert one(spark, keys.positive_decimal_id("t"), t=("string", raw)) == (expected,)


def test_dates(spark):
    cases = [
        ("2026-07-29T10:45:00+01:00", "2026-07-29T09:45:00Z"),
        ("2026-07-29T09:45:00.5z", "2026-07-29T09:45:00.500000Z"),
        ("2026-07-29T09:45:00", None),
        ("", None),
        ("2026-13-29T09:45:00Z", None),
    ]
    for raw, expected in cases:
        assert one(spark, dates.normalize_utc("t"), t=("string", raw)) == (expected,), raw
    mail = dates.mail_date_in_london("t")
    assert one(spark, mail, t=("string", "Fri, 30 Jan 2026 15:45:07 +0000")) == ("Fri, 30 Jan 2026 15:45:07 +0000",)
    assert one(spark, mail, t=("string", "Wed, 1 Jul 2026 09:00:00 -0400")) == ("Wed, 01 Jul 2026 14:00:00 +0100",)
    assert one(spark, mail, t=("string", "yesterday")) == ("yesterday",)


def test_two_digit_years_pivot_at_69(spark):
    assert one(spark, dates.flexible_date("t"), t=("string", "1/2/69")) == ("1969-02-01",)
    assert one(spark, dates.flexible_date("t"), t=("string", "1-2-68")) == ("2068-02-01",)
    assert one(spark, dates.flexible_date("t"), t=("string", "1/2-68")) == ("",)
    assert one(spark, dates.flexible_date("t"), t=("string", None)) == ("",)


def test_header_date_needs_the_day_first(spark):
    head = "EMAIL CONTENT:\nFrom: a\nTo: b\nSubject: c\nDate: {}\n"
    got = lambda d: one(spark, dates.header_date("t"), t=("string", head.format(d)))[0]
    assert tuple(got("Fri, 30 Jan 2026 15:45:07 +0000")) == ("30 Jan 2026", "15:45")
    assert tuple(got("30 Jan 2026")) == ("30 Jan 2026", None)
    assert tuple(got("15:45")) == (None, None)


def test_values(spark):
    for raw, expected in {': "x y"': "x y", "'a: \"b \"'": "b", " ,'q'\" ": "q", "": "", None: None}.items():
        assert one(spark, values.clean_value("t"), t=("string", raw)) == (expected,)
    assert one(spark, values.insulation_category("t"), t=("string", "TR27")) == ("TissueFaced PIR",)
    assert one(spark, values.insulation_category("t"), t=("string", "Not found")) == ("Not found",)
    assert one(spark, values.postcode_area("t"), t=("string", "WA4 6NL")) == ("WA",)
    assert one(spark, values.percent_text("n"), n=("double", 0.8125)) == ("81.2%",)
    assert one(spark, values.byte_size_text("n"), n=("long", 1536)) == ("1.50 KB",)
    assert one(spark, values.retry_delay_seconds("n"), n=("int", 500)) == (3600,)
    assert one(spark, values.readiness_delay_seconds("n"), n=("int", 3)) == (240,)


def test_vectors(spark):
    unit = vectors.l2_normalize("v")
    assert one(spark, unit, v=("array<double>", [3.0, 4.0])) == ([0.6, 0.8],)
    assert one(spark, unit, v=("array<double>", [0.0, 2.0])) == ([0.0, 1.0],)
    assert one(spark, unit, v=("array<double>", [0.0, 0.0])) == ([0.0, 0.0],)
    distance = one(spark, F.isnan(vectors.cosine_distance("v", "w")), v=("array<float>", [0.0, 0.0]), w=("array<float>", [1.0, 0.0]))
    assert distance == (True,)


def test_meaningful_words(spark):
    got = one(spark, words.meaningful_words("t"), t=("string", "The Café at St. John's Rd. 12B SW6 4LX GIR A12 New new no"))[0]
    assert got == ["Café", "St", "John's", "Rd", "New", "new"]
