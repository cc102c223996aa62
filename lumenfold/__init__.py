"""Spark-first analytics: text proximity scoring, event studies, allocation, inference and data quality."""
