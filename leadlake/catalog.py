"""All registered queries of the library and their SQL, gathered from the query modules."""

from __future__ import annotations

from leadlake.plans import documents, entities, leads, outcomes, pipelines, records, registry, scalars  # noqa: F401  each module registers its queries

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
FLAGSHIP = "C10_lead_board"
