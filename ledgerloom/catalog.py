"""The registered queries of the core, and their SQL for comparison."""

from __future__ import annotations

from .operators import drift, entities, graph, learning, observations, shred, similarity
from .plans import features, linkage, network, orders, review, scores, serving
from .sources import discovery
from .streaming import ingest

QUERIES = {
    "p2_found": shred.p2_found,
    "p2_lobbyists": shred.p2_lobbyists,
    "p2_cosponsors": shred.p2_cosponsors,
    "p6_found": drift.p6_found,
    "p6_table": drift.p6_table,
    "p6_failed_casts": drift.p6_failed_casts,
    "p6_paths": drift.p6_paths,
}
SQL = shred.SQL | drift.SQL

for module in (network, linkage, review, features, orders, scores, serving, observations, entities, graph, similarity, learning, ingest, discovery):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
