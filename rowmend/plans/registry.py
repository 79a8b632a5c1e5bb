"""Thin entry point: run one experiment by names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..core import Spec
from ..sources.readers import load_dataset
from .experiments import NOISE_TYPES, Experiment, run_experiment

MODELS = ("nb", "logistic", "forest")


def run(
    spark: SparkSession, dataset: str | tuple[DataFrame, Spec], noise_type: str, model: str = "nb",
    noise_level: float = 0.2, proportions: list[float] | None = None, folder: str | None = None,
    **options,
) -> Experiment:
    """Run ``noise_type`` on a named dataset in ``folder``, or on an own
    (frame, Spec) pair.  Unknown names raise ValueError."""
    if noise_type not in NOISE_TYPES:
        raise ValueError(f"unknown noise type {noise_type!r}; choose from {sorted(NOISE_TYPES)}")
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; choose from {sorted(MODELS)}")
    if isinstance(dataset, str):
        df, spec = load_dataset(spark, dataset, folder or ".", encode=False)
    else:
        df, spec = dataset
    return run_experiment(df, spec, noise_type, model, noise_level, grid=proportions, **options)
