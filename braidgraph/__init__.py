"""Continuous graph-pattern matching and corpus preparation on Spark."""
