"""Whole jobs, and the queries that bind the operators to the given tables."""
