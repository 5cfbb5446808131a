"""Functions of the entity engine."""
