"""Typed entities, declared indexes and queries on Spark."""
