"""Causal relational simulation, validation and corpus preparation on Spark."""
