"""Imports every query module and exposes the two registries."""

from __future__ import annotations

from tallywatch.plans import casework, checks, evaluation, forests, jobs, operations, pipeline  # noqa: F401
from tallywatch.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
