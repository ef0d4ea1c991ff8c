"""Reading, admitting and writing model tables."""
