"""All queries of the core library with their SQL."""

from __future__ import annotations

from . import assessments, evidence, governance, narratives, operations, records, reference, resolution, signals, state, surveillance, terminology

QUERIES = signals.QUERIES | operations.QUERIES | evidence.QUERIES | resolution.QUERIES | governance.QUERIES | assessments.QUERIES | records.QUERIES | narratives.QUERIES | surveillance.QUERIES | reference.QUERIES | terminology.QUERIES | state.QUERIES
ORACLES = signals.ORACLES | operations.ORACLES | evidence.ORACLES | resolution.ORACLES | governance.ORACLES | assessments.ORACLES | records.ORACLES | narratives.ORACLES | surveillance.ORACLES | reference.ORACLES | terminology.ORACLES | state.ORACLES
