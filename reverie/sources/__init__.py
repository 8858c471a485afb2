"""Sources of the memory store."""
