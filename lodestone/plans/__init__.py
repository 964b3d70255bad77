"""Plan helpers and the registry of queries."""
