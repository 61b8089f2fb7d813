"""Registered queries: each operator on the given tables, with its SQL where SQL can say it."""

from antipode.plans import registry
from antipode.plans.registry import ORACLE, QUERIES

registry.load_all()

__all__ = ["ORACLE", "QUERIES"]
