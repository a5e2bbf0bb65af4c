"""All queries of the timeline operators, with their SQL where SQL can express them."""

from __future__ import annotations

from .oracles import ORACLES
from .queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
