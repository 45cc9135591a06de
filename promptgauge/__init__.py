"""Prompt-sensitivity analytics as Spark DataFrame jobs."""
