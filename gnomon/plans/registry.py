"""Every query of the core with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gnomon.plans import clock_plans, coverage_plans, problems, relation_plans, scalar_plans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _part in (problems, scalar_plans, coverage_plans, relation_plans, clock_plans):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
