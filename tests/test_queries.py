"""Registered plans against their SQL on the smallest tables."""

import pytest

from tidewind.plans.catalog import all_queries

QUERIES, SQL = all_queries()
#: A query of each operator family; the driver compares them all.
NAMES = """panel_log_returns panel_quality_by_asset universe_select na_report_by_date source_corr source_merge ticks_last_close cross_section_vol clean_flag_dates clean_winsorize cellwise_mask extreme_class
tier_stats split_pattern_match window_validity window_impute cov_long cov_trace_guardrail vol_metrics vol_stats_embedding knn_l2 knn_angular knn_eligible regime_weights euclidean_forecast prototype_softmax
transition_soft forward_filter asof_alpha portfolio_stats turnover logm_2 logeuc_mean_2 kl_2 gmvp_2 report_pivot paired_wilcoxon rolling_median max_drawdown kde_grid pareto3 regime_profile simplex_grid
confidence_blend neighbour_regime_parts regime_top3 prob_normalised pooled_percentiles cellwise_worst unit_comparison run_summary spd_floor_2 corr_target_2 gmvp_shrink_blend_2 vol_stats_embed corr_eig_embed_2
pca_window_2 hybrid_embed_2 ward_groups signed_spectral_groups two_stage_groups gmm_fixed_point fcm_fixed_point kmeans_fixed_point backtest_bundle_2 backtest_cov_baselines gmvp_long_only_2 regime_profile_vol corr_clipped vol_knn_dampened wide_file_scan clean_file_scan archive_closes_between matrix_scan results_file_scan row_lookup""".split()


@pytest.mark.parametrize("name", NAMES)
def test_plan_matches_sql(name, same):
    same(QUERIES[name], SQL[name])


def test_rolling_queries_have_the_reference_stride():
    from tidewind.plans import forecasts

    assert (forecasts.L, forecasts.H, forecasts.STRIDE) == (50, 20, 5) and "% 7" not in SQL["asof_alpha"] and "dim <" not in SQL["euclidean_forecast"]


def test_every_sql_has_a_plan():
    assert set(SQL) <= set(QUERIES) and set(NAMES) <= set(SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_backtests_and_embeddings_have_the_reference_steps(spark, sf, monkeypatch):
    from tidewind.plans import backtest
    from tidewind.plans.panels import flags_panel

    seen, none = [], spark.createDataFrame([], "anchor int, value double")
    monkeypatch.setattr(backtest, "run", lambda panel, config: seen.append(config) or spark.createDataFrame([], "anchor int, method string, metric string, value double"))
    monkeypatch.setattr(backtest, "ablation", lambda panel, runs: seen.extend(runs.values()) or none)
    for name in ("backtest_cov", "backtest_vol", "ablation_grid"):
        QUERIES[name](spark, sf)
    assert len(seen) == 6 and {(c.stride, c.sample_stride, c.refit) for c in seen} == {(5, 3, 20)}
    rows = flags_panel(spark, sf).select("t").distinct().count()
    assert QUERIES["pca_embed"](spark, sf).count() == 25 * len(range(49, rows - 20, 5))
