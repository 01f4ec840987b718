"""Named queries and the SQL that states the same results."""

from __future__ import annotations

from . import calls, markup, protection, subjects  # noqa: F401  register their queries
from .signals import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
