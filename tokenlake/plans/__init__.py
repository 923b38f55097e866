"""Registered queries (QUERIES) and the same in SQL (ORACLES)."""

from tokenlake.plans import errors, scans, signals, tokens, training
from tokenlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "errors", "scans", "signals", "tokens", "training"]
