"""Agent-memory analytics as Spark DataFrame operators."""
