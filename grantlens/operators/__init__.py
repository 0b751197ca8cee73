"""DataFrame -> DataFrame operators (joins, closures, aggregations)."""
