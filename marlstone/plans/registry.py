"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from marlstone.plans import catalog, effects, relational, scale

QUERIES: dict[str, catalog.Query] = catalog.QUERIES | relational.QUERIES | effects.QUERIES | scale.QUERIES
ORACLES: dict[str, str] = catalog.ORACLES | relational.ORACLES | effects.ORACLES | scale.ORACLES
