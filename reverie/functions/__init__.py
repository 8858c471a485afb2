"""Functions of the memory store."""
