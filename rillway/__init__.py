"""Spark-first analytics over retrieval, ranking and procurement text."""
