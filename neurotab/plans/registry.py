"""Query registry shared by the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


PLAN_MODULES = [
    "q_spectral", "q_signal", "q_time", "q_nonlinear", "q_features", "q_evaluation", "q_folds", "q_models",
    "q_sources", "q_views", "q_streaming",
]


def load_all() -> None:
    """Import every plan module so that its queries register themselves."""
    import importlib
    import importlib.util

    for m in PLAN_MODULES:
        name = f"neurotab.plans.{m}"
        if importlib.util.find_spec(name) is not None:
            importlib.import_module(name)
