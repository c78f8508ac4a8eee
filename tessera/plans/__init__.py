"""Whole flows over the operators, and the queries over the standard tables."""
