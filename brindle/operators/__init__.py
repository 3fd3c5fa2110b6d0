"""DataFrame operators: search, lookups, windows, versions, metrics."""
