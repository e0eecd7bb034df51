"""Scalar functions, predicates and the classification table."""
