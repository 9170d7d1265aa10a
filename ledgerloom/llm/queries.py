"""The registered queries of this package, and their SQL for comparison."""

from __future__ import annotations

from . import components, crossmatch, mixing, names, packing, places, residue, topn

QUERIES = {
    "p1_found": names.p1_found,
    "p1_entities": names.p1_entities,
    "p3_found": components.p3_found,
    "p4_found": topn.p4_found,
    "p5_found": places.p5_found,
    "p5_spots": places.p5_spots,
    "p5_candidates": places.p5_candidates,
    "p7_found": crossmatch.p7_found,
    "p7_matches": crossmatch.p7_matches,
    "p7_members": crossmatch.p7_members,
    "p7_reliability": crossmatch.p7_reliability,
    "p8_containers": packing.p8_containers,
    "p8_fill": packing.p8_fill,
    "p8_limits": packing.p8_limits,
    "p9_mix": mixing.p9_mix,
    "p9_shares": mixing.p9_shares,
    "p9_accuracy": mixing.p9_accuracy,
    "p9_limits": mixing.p9_limits,
    "p10_found": residue.p10_found,
    "p10_units": residue.p10_units,
}
SQL = {"p3_found": components.P3_FOUND_SQL, "p4_found": topn.P4_FOUND_SQL} | packing.SQL | mixing.SQL
