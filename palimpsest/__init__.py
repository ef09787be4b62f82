"""Agent-memory analytics on Spark: composable DataFrame operators."""
