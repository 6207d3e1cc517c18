"""All registered queries of the photo catalog, and their DuckDB SQL."""

from shutterlake.plans import catalog_queries, identity_queries, journal_queries, media_queries, more_queries, stored_queries, upkeep_queries  # noqa: F401  they register themselves

QUERIES, ORACLES = catalog_queries.QUERIES, catalog_queries.ORACLES
