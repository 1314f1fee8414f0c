"""Physical-plan discipline: what the optimizer produces for the headline queries."""

import re

import pytest

from conftest import SF001
from quiver import registry as R

HEADLINE = ["holdout_split", "bootstrap_exact", "bootstrap_poisson", "double_bootstrap", "classification_report",
            "naive_bayes_predict", "prune_weights", "evaluate_config", "single_vs_double", "expand_config",
            "flatten_nested_qa", "consolidate"]


def _plan(spark, name):
    return R.QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", HEADLINE)
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_poisson_bootstrap_is_map_only(spark):
    plan = _plan(spark, "bootstrap_poisson")
    assert "Exchange" not in plan and plan.count("md5(") == 1


def test_scans_are_pruned(spark):
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", _plan(spark, "bootstrap_exact"))
    assert schemas and all("embedding" not in s for s in schemas)
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", _plan(spark, "task_of_path"))
    assert schemas and all("html" not in s for s in schemas)


def test_aggregates_combine_before_shuffle(spark):
    plan = _plan(spark, "consolidate")
    assert "partial_max_by" in plan
    plan = _plan(spark, "train_naive_bayes")
    assert "partial_sum" in plan


def _initial(spark, name):
    return R.QUERIES[name](spark, SF001)._jdf.queryExecution().sparkPlan().toString()


# Scans and joins that shuffle both sides, in the plan of the query's last job
CEILINGS = {
    "prune_weights": (6, 0), "count_weights": (7, 0), "holdout_split": (3, 0), "naive_bayes_predict": (8, 2), "eval_metrics": (8, 2),
    "classification_report": (4, 0), "train_centroids": (2, 0), "score_models": (3, 0), "report_errors": (6, 2),  # two of them are the written errors of bad models, one for each task
}


@pytest.mark.parametrize("name", CEILINGS)
def test_scan_and_shuffle_join_ceilings(spark, name):
    plan = _initial(spark, name)
    scans, joins = CEILINGS[name]
    assert len(re.findall(r"FileScan parquet", plan)) <= scans
    assert len(re.findall(r"SortMergeJoin|ShuffledHashJoin", plan)) <= joins


@pytest.mark.parametrize("name", sorted(R.QUERIES))
def test_every_query_is_planned_without_a_cross_product(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert len(re.findall(r"FileScan parquet|Scan parquet", plan)) <= 24
