"""All registered queries and their SQL twins."""

from __future__ import annotations

from regionmatch.plans import contract_checks, descriptors, end_to_end, learning, matching, raster, regions, scoring, texture_maps, training

_PARTS = (scoring, contract_checks, raster, regions, matching, training, learning, texture_maps, end_to_end, descriptors)

QUERIES: dict = {}
ORACLE: dict = {}
for _part in _PARTS:
    QUERIES.update(_part.QUERIES)
    ORACLE.update(_part.ORACLE)
