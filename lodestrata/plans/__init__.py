"""Query plans: filters as columns and semi-joins, nested assembly, paging, statistics."""
