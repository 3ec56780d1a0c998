"""Scalar functions, predicates and clocks as Column expressions."""
