"""Library results against SQL on another engine, on whole (small) tables."""

import pytest

from checks.compare import connect, differences
from checks.queries import QUERIES, SQL

# the cheap ones; checks/compare.py runs all of them
NAMES = [
    "scan_delimited_header_less", "derive_binary_label", "protected_mask", "factorize", "row_provenance",
    "global_rank", "global_rank_ties", "global_rank_hash", "split_train_val_test", "val_cap",
    "sample_exact_uniform", "sample_exact_in_group", "stratified_kfold", "inject_outlier",
    "inject_outlier_pooled", "inject_random_label", "inject_group_label", "inject_group_missing",
    "action_cap", "action_remove", "action_restore_labels",
    "cleaned_prefix", "cleaned_prefix_capped", "impute_median", "impute_mode", "standard_scale",
    "yeo_johnson_fixed", "anova_f", "oof_predict", "knn_shapley", "knn_shapley_k5", "knn_shapley_orders",
    "dp_shapley", "dp_heuristic", "confident_joint", "find_label_issues", "entropy_rank",
    "random_rank", "accuracy", "demographic_parity_gap", "cleaning_curve",
    "group_mc_shapley", "record_sink", "otsu_threshold",
    "kernel_similarity", "detect_noise_type",
]


def test_names_are_registered():
    assert set(NAMES) <= set(SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, small, con, name):
    got = QUERIES[name](spark, small).toPandas()
    assert len(got)
    assert differences(got, con.execute(SQL[name]).df()) is None
