"""The analytic path from trace to ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.assignments import execution_records
from ..operators.counterfactual import avg_outcome_by_rep, ranking, suspiciousness
from ..operators.dataset import training_dataset
from ..operators.models import fit_models
from ..session import settle


def rank_dataset(dataset: DataFrame, models: DataFrame, exclude_vars=None) -> DataFrame:
    """Suspiciousness ranking of a dataset's variables under given models."""
    return ranking(suspiciousness(avg_outcome_by_rep(dataset, models)), exclude_vars)


def rank_records(
    records: DataFrame, order: list[str], ridge: float = 1e-3, exclude_vars=None
) -> DataFrame:
    """Preprocess, fit and rank. Records and dataset are settled: later steps reread them."""
    dataset = settle(training_dataset(settle(records), order))
    return rank_dataset(dataset, fit_models(dataset, ridge=ridge), exclude_vars)


def rank_trace(
    trace: DataFrame,
    parents: DataFrame,
    test_args: DataFrame | None = None,
    ridge: float = 1e-3,
    exclude_vars=None,
) -> DataFrame:
    """Ranking straight from a trace and its parent map."""
    records = execution_records(trace, parents, test_args)
    return rank_records(records, ["run_id", "first_seq"], ridge, exclude_vars)
