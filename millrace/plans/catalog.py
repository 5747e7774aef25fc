"""Every query of the core by name, with the SQL that states it."""

from __future__ import annotations

from . import aggregations, filters, formats, learning, ordering, preparation, texts  # noqa: F401  (importing registers the queries)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
