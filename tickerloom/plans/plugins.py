"""What users may plug in: feature sets, models and steps, all over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.operators.tracking import steps_to_resume

Step = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


@runtime_checkable
class FeaturePlugin(Protocol):
    """Adds columns to a panel; used through ``DataFrame.transform``."""

    def compute(self, df: DataFrame) -> DataFrame: ...

    def get_feature_names(self) -> Sequence[str]: ...


@runtime_checkable
class ModelPlugin(Protocol):
    """Any ``pyspark.ml`` estimator fits: ``fit`` gives a transformer that adds ``probability`` or ``prediction``."""

    def fit(self, dataset: DataFrame): ...


def apply_features(df: DataFrame, plugins: Sequence[FeaturePlugin]) -> DataFrame:
    out = df
    for p in plugins:
        out = out.transform(p.compute)
        missing = [n for n in p.get_feature_names() if n not in out.columns]
        if missing:
            raise ValueError(f"{type(p).__name__} did not add {', '.join(missing)}")
    return out


def run_steps(steps: Sequence[tuple[str, Step]], tables: dict[str, DataFrame], run_id: str, done: DataFrame | None = None,
              on_status: Callable[[str, str], None] | None = None) -> dict[str, DataFrame]:
    """Runs named steps in order and skips those the step log shows as completed. Steps pass DataFrames, so a skipped
    step's results must be readable tables the later steps load themselves."""
    names = [n for n, _ in steps]
    todo = set(names)
    if done is not None and names:
        spark = done.sparkSession
        planned = spark.createDataFrame([(run_id, n) for n in names], "run_id string, step_name string")
        todo = {r["step_name"] for r in steps_to_resume(planned, done.where(F.col("run_id") == run_id)).collect()}
    for name, step in steps:
        if name not in todo:
            continue
        try:
            tables = {**tables, **step(tables)}
        except Exception:
            if on_status:
                on_status(name, "failed")
            raise
        if on_status:
            on_status(name, "completed")
    return tables
