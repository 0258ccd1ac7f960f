"""Each stage against a plain version on its own input, and the pipeline as a whole."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_texts import DE, EN, linked_by_hand

ITEM = "The quick brown fox jumps over the lazy dog near the quiet river bank at dawn today."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    path = str(tmp_path_factory.mktemp("tables"))
    docs, labels = [], []
    for i in range(120):
        base = (EN if i % 3 else DE).split()
        ws = [rng.choice(base) for _ in range(40)]
        bad = i % 10 == 0
        docs.append((i, " ".join(w.upper() + "!!" if bad else w for w in ws), "en" if i % 3 else "de", f"s{i % 2}", 1))
        labels.append((i, 0 if bad else 1, 0))
    docs += [(200, docs[1][1], "en", "s0", 1), (201, docs[2][1] + " end", "en", "s0", 1), (202, None, "en", "s0", 1), (203, "12 34", "en", "s0", 1)]
    docs += [(204, docs[5][1] + " " + ITEM, "en", None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_stage_takes_effect_and_keeps_clean_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    gone = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == columns
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        gone.append(ids - kept)
        if name == "near_duplicates":
            assert kept == {low for _, _, low in linked_by_hand(before)}
        ids = kept
    assert gone[0] == {202, 203}
    assert gone[1] == {i for i in range(0, 120, 10)}
    assert {200, 201} <= gone[2]
    assert gone[3] == {204}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    tokens = sum(len(r["text"].split()) + 1 for r in docs.collect())
    assert packed.agg(F.sum("length")).first()[0] == tokens


def test_run_applies_all_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and {r["doc_id"] for r in rows}.isdisjoint({202, 203, 200, 204, 0, 10})


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_mixtures_of_languages_go_and_clean_documents_stay(spark, folder):
    """An even mixture of three languages has no main one; null and repeated ids and clashing names change nothing."""
    third = "la casa y el jardín con unos árboles están allí mientras la gente camina a casa"
    rng = random.Random(2)

    def text(base, n=40):
        return " ".join(rng.choice(base.split()) for _ in range(n))

    rows = [(i, text((EN, DE, third)[i % 3]), ("en", "de", "es")[i % 3], "x") for i in range(90)]
    mixed = [(None, "\n".join(text(b) for b in (EN, DE, third)), None, "x") for _ in range(3)]
    names = "doc_id long, text string, lang string, share string"
    docs = spark.createDataFrame([*rows, rows[0], *mixed, (None, rows[1][1], None, "x")], names)
    docs = docs.selectExpr("*", "1 as _id", "2 as _turn", "3 as _digest", "4 as language", "5 as score")
    kept = corpus_pipeline.language_id(spark, docs, folder)
    assert kept.columns == docs.columns and kept.count() == 92
    assert kept.filter("doc_id is null").count() == 1
    judged = corpus_pipeline.quality_classifier(spark, kept, folder)
    assert judged.columns == docs.columns
    single = corpus_pipeline.near_duplicates(spark, kept, folder)
    assert single.columns == docs.columns and {tuple(r)[4:] for r in single.collect()} == {(1, 2, 3, 4, 5)}
    assert single.filter("doc_id = 0").count() == 1
    clean = corpus_pipeline.benchmark_leaks(spark, single, folder)
    assert clean.columns == docs.columns and clean.count() == single.count()
    assert corpus_pipeline.sequence_packing(spark, clean, folder).count() >= clean.count()
