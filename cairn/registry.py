"""All queries and SQL oracles of the engine's own operators."""

from __future__ import annotations

from cairn.plans import QUERIES, ORACLES  # noqa: F401
