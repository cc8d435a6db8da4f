"""Every query with an oracle text against DuckDB at sf0.001 (the driver's gate
runs the same comparison at sf0.01, see tools/check_oracle.py)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import oracle

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ok, msg = oracle.compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert ok, msg


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"regime", "MAC_CODE", "n", "pitch_before_median", "speed_std_median", "target_median"}


def test_every_query_has_oracle_or_is_a_model():
    """Tree and cluster models, and what is read off them, have no SQL form; they
    are tested in test_models.py."""
    from gustframe.plans import catalog
    catalog.load_all()
    models = {"forest_regressor", "boosted_regressor", "logit_no_intercept", "logit_summary", "tree_classifier", "pca_loadings", "pca_scores", "kmeans_groups",
              "kmeans_labels", "cluster_profile_correlation", "regime_pipeline", "single_pipeline", "PipelineOf",
              "interaction_pipeline", "cross_validate", "cross_validate_regimes", "search_params", "compare_models",
              "compare_residual_trend", "importance_over_splits", "rank_importance"}
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == models
