"""Physical-plan checks: pushdown, pruning, top-k limits, no Cartesian products."""
import pytest

from cadenza.plans.registry import load_all
from conftest import SF_SMALL

REG = load_all()


def _plan(spark, name):
    return REG[name].fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


def test_filter_pushed_to_scan(spark):
    p = _plan(spark, "flt_genre")
    assert "PushedFilters: [IsNotNull(p_type), EqualTo(p_type,PROMO)]" in p
    assert "documents.parquet" not in p  # the lyrics join is not planned when unused


def test_column_pruning(spark):
    p = _plan(spark, "topk_popular")
    assert "ReadSchema: struct<p_partkey:bigint,p_type:string,p_retailprice:double>" in p


@pytest.mark.parametrize("name", ["topk_popular", "rec_raw_vector", "join_knn", "rec_similar"])
def test_topk_uses_window_group_limit(spark, name):
    p = _plan(spark, name)
    assert "WindowGroupLimit" in p and "Partial" in p


@pytest.mark.parametrize("name", ["rec_raw_vector", "join_knn", "man_silhouette", "rec_item_cf", "rec_text_rerank",
                                  "eva_compare_models", "idea_cross_genre", "dedup_keep_first", "mod_triplets"])
def test_no_cartesian_product(spark, name):
    p = _plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_keep_first_is_partial_aggregate(spark):
    p = _plan(spark, "dedup_keep_first")
    assert "partial_min" in p


def test_semi_join_pre_aggregates(spark):
    p = _plan(spark, "join_semi_hits")
    assert "LeftSemi" in p and "HashAggregate" in p

