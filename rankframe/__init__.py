"""Parallel data primitives as composable Spark DataFrame operators."""
