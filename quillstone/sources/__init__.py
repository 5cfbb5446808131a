"""Sources of the entity engine."""
