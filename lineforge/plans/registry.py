"""Query registry shared by the catalog modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import validate as V
from . import derived as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Decorator: register a ``(spark, sf_dir) -> DataFrame`` query and its oracle SQL."""
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> delivery lines -> rule join -> cleaning + tab check."""
    return V.validate_lines(V.rule_join(D.doc_lines(spark, sf_dir), D.run_rules(spark)))
