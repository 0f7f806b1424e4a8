"""DataFrame operators (joins, aggregations, windows, sequence numbering, merges, reports)."""
