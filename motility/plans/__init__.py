"""Domain views over the base tables, and the registered queries with their SQL."""

from motility.plans import flagship, queries_behaviors, queries_geometry, queries_regions, queries_tracks, queries_voxels  # noqa: F401
from motility.plans.registry import QUERIES, SQL  # noqa: F401
