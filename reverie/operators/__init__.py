"""Operators of the memory store."""
