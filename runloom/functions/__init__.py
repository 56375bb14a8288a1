"""Column expressions: no shuffles, usable in batch and in streams."""
