"""Composed jobs and the register of named queries."""

from pressroom.plans import (  # noqa: F401  (fill the register)
    catalogue_queries,
    change_queries,
    intake_queries,
    text_queries,
)
from pressroom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
