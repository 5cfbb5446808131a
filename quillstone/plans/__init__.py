"""Plans of the entity engine."""
