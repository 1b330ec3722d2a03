"""Column-level building blocks: names, predicates, aggregates, time rules."""
