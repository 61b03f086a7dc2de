"""All queries of the engine and their oracles."""

from __future__ import annotations

from ledgerlake.operators import aggregates, archived, conformal, deepdiff, evidence, floors, geometry, graph, isotonic, joins, labelling, methods, ranking, records, resample, scalar, sets, statistics, treedigest  # noqa: F401
from ledgerlake.plans.registry import FLAGSHIP, ORACLES, QUERIES  # noqa: F401
from ledgerlake.streaming import batches, state  # noqa: F401
