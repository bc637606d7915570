"""Whole requests composed from the operators, and the queries over the driver's tables."""
