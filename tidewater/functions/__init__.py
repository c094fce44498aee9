"""Column builders: predicates and scalar functions."""
