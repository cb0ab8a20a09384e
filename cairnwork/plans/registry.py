"""All queries by name, with the SQL that states the same result."""

from cairnwork.plans import base, evaluation, modelling, profiling, rebalancing, scans, series, splitting, stattesting  # noqa: F401 - each module registers its queries

QUERIES = base.QUERIES
ORACLES = base.ORACLES
