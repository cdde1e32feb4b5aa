"""The reference's operators as named queries, each with its SQL where SQL can say it."""

from __future__ import annotations

from . import classification, cleaning, generation, mixtures, scoring, series, splits, tokens
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
