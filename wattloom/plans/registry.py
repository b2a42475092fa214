"""Imports every module that registers queries."""

from wattloom.plans import base_sql  # noqa: F401
from wattloom.plans import queries_energy, queries_ingest  # noqa: F401
from wattloom.plans import queries_billing, queries_decide, queries_health, queries_schedule, queries_sources, queries_streaming  # noqa: F401
from wattloom.plans.common import ORACLE, QUERIES, oracle_statements

__all__ = ["ORACLE", "QUERIES", "oracle_statements"]
