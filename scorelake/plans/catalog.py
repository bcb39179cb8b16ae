"""Imports every module that registers queries."""

from scorelake.plans import evidence, layout, lists, measures, relations, rhythm, rules, scans, sessions, streams, texts  # noqa: F401
from scorelake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
