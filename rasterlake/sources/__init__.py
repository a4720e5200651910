"""Table readers, ingest checks, sinks and the derived tables used by the queries."""
