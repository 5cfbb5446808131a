"""Operators of the entity engine."""
