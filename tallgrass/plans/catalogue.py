"""All registered queries and their SQL."""

from __future__ import annotations

from . import accounts, analytics, campaigns, connectors, deciders, decisions, entities, extraction, imports, lifecycle, listings, phones, profiles, progress, register, rubrics, rules, search, sheets  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
