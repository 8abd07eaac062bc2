"""All registered queries; those of the subpackage `llm` only where it can be imported."""

from __future__ import annotations

import importlib
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from retentia import problems
from retentia.plans import queries as core


def _modules() -> list:
    """The core modules, and the queries of `llm` unless that subpackage or something it needs is absent."""
    try:
        return [problems, core, importlib.import_module("retentia.llm.queries")]
    except ImportError as e:
        warnings.warn(f"queries of the subpackage llm are left out: {e}", RuntimeWarning, stacklevel=3)
        return [problems, core]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.SQL.items()}
