"""The registered queries of the library's own operators, with SQL that gives the same rows."""

from __future__ import annotations

from . import control, fits, images, live, pictures, predicates, recordings, records, rows, scenes, series, structures, vessels
from .registry import oracle_sql, queries

__all__ = ["control", "fits", "images", "live", "oracle_sql", "pictures", "predicates", "queries", "recordings", "records", "rows", "scenes", "series", "structures", "vessels"]
