"""Column builders: time algebra, scalars, hashes."""
