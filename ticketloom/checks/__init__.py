"""Registered queries, one per operator, with the SQL that checks them."""

from ticketloom.checks.registry import ORACLES, QUERIES
from ticketloom.checks import (  # noqa: F401
    model_queries,
    pipeline_queries,
    profile_queries,
    rule_queries,
    summary_queries,
    text_queries,
)

__all__ = ["ORACLES", "QUERIES"]
