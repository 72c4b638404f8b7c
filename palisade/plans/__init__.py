"""Registered queries over the fixture tables, each with its SQL twin where SQL can say it."""

from palisade.plans.registry import oracles, queries

__all__ = ["oracles", "queries"]
