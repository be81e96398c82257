"""Spark ML stages, training runs and scoring."""
