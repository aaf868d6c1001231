"""Registered queries: the library's jobs over the given tables."""

from zonedeck.plans import (  # noqa: F401
    keyed_files,
    log_jobs,
    money_jobs,
    program_jobs,
    records,
    retrieval_jobs,
    stream_jobs,
)
from zonedeck.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
