"""Collects the named queries of the library and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("sequence_queries", "kernel_queries", "source_queries", "codec_queries")


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for name in MODULES:
        out |= import_module(f"framewright.plans.{name}").QUERIES
    return out


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= import_module(f"framewright.plans.{name}").SQL
    return out
