"""Column functions: predicates, arithmetic, aggregates, dictionaries, formatting."""
