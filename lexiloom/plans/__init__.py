"""Compositions of operators, and the queries that run over the driver's tables."""
