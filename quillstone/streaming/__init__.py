"""Streaming of the entity engine."""
