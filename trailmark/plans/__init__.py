"""Pattern descriptions and the compiler from patterns to plans."""
