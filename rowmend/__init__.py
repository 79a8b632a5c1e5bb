"""Finding, repairing and auditing bad rows in tabular training data."""

from .core import Spec, ensure_checkpoint_dir, nan_to_null, stable
from .models.mllib import forest_model, logistic_model
from .models.naive_bayes import NaiveBayes
from .operators.confident import (
    confident_joint,
    find_label_issues,
    rank_by_entropy,
    rank_random,
    self_confidence,
)
from .operators.encode import binary_label, cast_double, factorize, member
from .operators.fairness import parity_impact_scores, rank_by_parity_impact
from .operators.metrics import accuracy, demographic_parity_gap, evaluate, random_mean_std
from .operators.noise import (
    inject_group_label,
    inject_group_missing,
    inject_outlier,
    inject_outlier_pooled,
    inject_random_label,
)
from .operators.ranking import first_rows, hash_rank, score_rank
from .operators.repair import (
    action_cap,
    action_flip,
    action_remove,
    action_restore_labels,
    apply_prefix,
    in_prefix,
    proportion_grid,
)
from .operators.sampling import exact_sample, split_rows, stratified_folds
from .operators.shapley import knn_shapley, rank_by_shapley
from .plans.experiments import (
    Experiment,
    run_experiment,
    run_group_label,
    run_group_missing,
    run_no_noise_control,
    run_outlier,
    run_outlier_removal,
    run_random_label,
)
from .plans.registry import run
from .sources.readers import frame_of, load_dataset, read_delimited, read_header_csv

__all__ = [name for name in dir() if not name.startswith("_")]
