"""The plans keep the properties that matter at scale."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from worklens import session
from worklens.operators import ingest
from worklens.plans import lifecycle
from worklens.queries import plan_tables as t
from worklens.queries.base import table

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_per_key_limits_groups_before_the_shuffle(spark):
    plan = plan_of(lifecycle.latest_complete(t.SNAPSHOTS.df(spark, SF)))
    below = plan[plan.index("Exchange hashpartitioning") :]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(entry.queries()["active_projects_since"](spark, SF))
    scan = plan[plan.index("FileScan") :]
    assert "o_orderstatus" in scan[scan.index("PushedFilters") :]
    assert "o_orderpriority" in scan and "o_totalprice" not in scan[scan.index("ReadSchema") :]


@pytest.mark.parametrize(
    "name", ["text_chunks", "asset_routes", "event_normalisation", "canonical_parameters", "target_readiness", "event_fan_out"]
)
def test_row_rules_do_not_shuffle(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert plan.count("Exchange") == (1 if name == "asset_routes" else 0)


def test_no_cartesian_products(spark):
    for name in ("vector_top_k", "word_containment", "event_claims", "operations_metrics", "design_queue_plan", "candidate_merge"):
        plan = plan_of(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_chunk_text_is_cut_once(spark):
    documents = table(spark, SF, "documents").select(
        F.col("doc_id").alias("file_id"), F.lit("pdf").alias("kind"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("int").alias("page"), "text"
    )
    assert plan_of(ingest.chunk_documents(documents)).count("regexp_extract_all") == 1


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Cluster:
        conf = Conf()
        sparkContext = spark.sparkContext

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Cluster())


def test_metrics_need_few_scans(spark):
    frame = entry.queries()["operations_metrics"](spark, SF)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    # Items and artifacts once; dispatches and the latencies twice each over one exchange; jobs once more.
    assert sum("Relation [" in line for line in plan.splitlines()) <= 7, plan
