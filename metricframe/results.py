"""Running a model, and what comes of it."""

from __future__ import annotations

import sys
import time
from dataclasses import dataclass, field
from functools import cached_property
from typing import TYPE_CHECKING, Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame

from metricframe.plans.lower import lower_model

if TYPE_CHECKING:
    from metricframe.model import Model


class RunResultsError(Exception):
    """A run that failed, while it was compiled or on the data."""

    def __init__(self, phase: str, cause: Exception) -> None:
        super().__init__(f"{phase} error: {cause}")
        self.phase = phase


@dataclass
class RunResults:
    """A result: lazily as ``spark_df``; run by ``df``, ``py_records`` or ``arrow``."""

    spark_df: DataFrame
    warnings: list[str] = field(default_factory=list)
    stats: dict[str, float] = field(default_factory=dict)

    @cached_property
    def df(self) -> Any:
        began = time.time()
        try:
            return self.spark_df.toPandas()
        except Exception as cause:
            raise RunResultsError("data", cause) from cause
        finally:
            self.stats["seconds"] = time.time() - began

    @cached_property
    def arrow(self) -> Any:
        return self.spark_df.toArrow()

    @property
    def py_records(self) -> list[dict]:
        return [row.asDict(recursive=True) for row in self.spark_df.toLocalIterator()]

    @property
    def sql_query(self) -> str:
        return _optimized(self.spark_df)

    def __len__(self) -> int:
        return len(self.df)


def _optimized(df: DataFrame) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def plan_text(model: Model) -> str:
    return _optimized(_lowered(model)[0])


def _lowered(model: Model) -> tuple[DataFrame, list[str]]:
    if model.source is None or model.connection is None:
        raise ValueError("the model has no source or connection")
    try:
        df, context = lower_model(model)
    except (AnalysisException, ParseException) as cause:
        raise RunResultsError("compile", cause) from cause
    return df, context.warnings


def run(model: Model, *, print_warnings: bool = True, print_exec_stats: bool = False) -> RunResults:
    df, warnings = _lowered(model)
    results = RunResults(df, warnings)
    if print_warnings:
        for warning in warnings:
            print(f"warning: {warning}", file=sys.stderr)
    if print_exec_stats:
        results.df  # noqa: B018 - run now
        print(results.stats, file=sys.stderr)
    return results
