"""DataFrame -> DataFrame building blocks: joins, aggregates, ordering and
set operations, and the round-based greedy selection."""
