"""All queries of the catalogue."""

from __future__ import annotations

from . import agreement, analytics, languages, pages, ruled, search, texts
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "agreement", "analytics", "languages", "pages", "ruled", "search", "texts"]
