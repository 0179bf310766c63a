"""Registered queries over the benchmark tables and their independent SQL twins."""

from . import clouds, comparison, evaluation, logs, recordings, streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
