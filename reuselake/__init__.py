"""Reuse-governed analytics as Spark DataFrame transformations."""
