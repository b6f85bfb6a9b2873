"""Windowed risk indicators and alert rules as Spark DataFrame operators."""
