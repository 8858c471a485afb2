"""Streaming of the memory store."""
