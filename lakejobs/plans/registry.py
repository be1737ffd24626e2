"""All registered queries and their oracles, collected from the plan modules."""

from __future__ import annotations

from lakejobs.plans import catalog, conformance, lake, streams, telemetry, vectors

QUERIES: dict = {}
ORACLE: dict = {}
for _m in (lake, conformance, telemetry, catalog, vectors, streams):
    QUERIES.update(_m.QUERIES)
    ORACLE.update(_m.ORACLE)
