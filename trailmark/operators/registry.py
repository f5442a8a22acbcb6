"""Queries of the observation engine and their SQL, by operator id."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
