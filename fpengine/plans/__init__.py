"""Composed plans and the registry of queries over the driver's tables."""
