"""All registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brinewatch.operators import attack, baselines, detectors, escalation, exposure, graphs, intake, ledger, lifetimes, logs, merkle, posture, raw, reconstruct, records, rules, series, states, windows
from brinewatch.streaming import flows, stateful

MODULES: list = [windows, intake, raw, detectors, escalation, graphs, lifetimes, baselines, ledger, records, merkle, states, reconstruct, logs, series, attack, posture, rules, flows, stateful, exposure]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql.replace(graphs.STRONGEST, "") if sql.startswith(graphs._TRADE) else sql for name, sql in small_sql().items()}


def small_sql() -> dict[str, str]:
    """The SQL with graphs as SMALL has them, for tests."""
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
