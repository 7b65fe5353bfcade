"""Queries over the given tables, each with its SQL twin where SQL can say it."""

from bidflow.checks import reading, refining, reporting, storing  # noqa: F401
from bidflow.checks.registry import QUERIES, TWINS, runner

__all__ = ["QUERIES", "TWINS", "runner"]
