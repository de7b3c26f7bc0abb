"""Registry of the library's named queries."""

from __future__ import annotations

from . import fits, formulas, scoring

QUERIES = {**formulas.QUERIES, **fits.QUERIES, **scoring.QUERIES}
ORACLES: dict[str, str] = {**formulas.ORACLES, **fits.ORACLES, **scoring.ORACLES}
